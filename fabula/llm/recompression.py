"""Substring dedup by recompression of word sequences.

Words are named by hashes of their bytes, runs and pairs of symbols by hashes of their parts' names, so equal
substrings get equal symbols everywhere in the corpus, but for what lies near their ends. A symbol is used only
with its context: the words that decide its borders. Every window of words takes as its seed the least-hashed symbol
whose context lies inside it; equal windows take equal seeds. Shared seeds reveal repeats, which are then verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm.repeats import FOUND, PER_DOC, SENT_FAMILIES, Scheme, Units, by_document, dealt, match_families, merged_runs, repeated_runs, send_families, with_runs
from fabula.llm.shared import bucketed, passing, slots, stored, texts
from fabula.llm.textkit import SPACE_WORDS, Words, mix, parts, prefix, slices, text_bytes

WINDOW = 13
PAIR_ROUNDS = 2


def word_units(raw: np.ndarray, off: np.ndarray) -> Units:
    words = Words(raw, off, SPACE_WORDS)
    return Units(words.hashes(), words.row_at, words.hashes(1))


class Symbols:
    """A level of the recompressed sequences: names, word ranges, and the word ranges that decide each symbol."""

    def __init__(self, units: Units):
        n = len(units.codes)
        self.name = units.codes
        self.row = np.repeat(np.arange(len(units.at) - 1), np.diff(units.at))
        self.begin, self.end = np.arange(n), np.arange(1, n + 1)
        self.low, self.high = self.begin, self.end

    def outside(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether a symbol has a left and a right neighbour in its row, and the contexts of these."""
        joined = self.row[1:] == self.row[:-1]
        far = np.int64(1) << np.int64(60)
        left, right = np.append(False, joined), np.append(joined, False)
        # a missing neighbour could be any word in another text: no window decides such a symbol
        low = np.where(left, np.append(-far, self.low[:-1]), -far)
        high = np.where(right, np.append(self.high[1:], far), far)
        return left, right, low, high

    def merged(self, first: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Symbols that begin at `first` are joined with those up to the next one."""
        last = np.append(first[1:], len(self.name)) - 1
        self.begin, self.end, self.row = self.begin[first], self.end[last], self.row[first]
        self.name, self.low, self.high = name, low, high

    def runs(self) -> None:
        """Runs of equal symbols become one; a run's neighbours decide where it ends."""
        if not len(self.name):
            return
        left, _, low, high = self.outside()
        first = np.flatnonzero(~(left & np.append(False, self.name[1:] == self.name[:-1])))
        last = np.append(first[1:], len(self.name)) - 1
        size = (last - first + 1).astype(np.uint64)
        name = np.where(size > 1, mix(self.name[first] + size * np.uint64(0x9E3779B97F4A7C15)), self.name[first])
        self.merged(first, name, low[first], high[last])

    def pairs(self, salt: int) -> None:
        """Neighbours of the left and the right half of the names become one. An unpaired symbol is decided by the neighbour that it might have joined, too."""
        if not len(self.name):
            return
        is_left = (mix(self.name + np.uint64(salt)) >> np.uint64(63)) == 0
        left, right, low, high = self.outside()
        opens = is_left & right & np.append(~is_left[1:], False)
        closes = np.append(False, opens[:-1])
        low = np.where(is_left | closes, self.low, np.minimum(self.low, low))
        high = np.where(~is_left | opens, self.high, np.maximum(self.high, high))
        first = np.flatnonzero(~closes)
        last = np.append(first[1:], len(self.name)) - 1
        name = np.where(opens[first], mix(self.name[first] * np.uint64(0xD6E8FEB86659FD93) + mix(self.name[last])), self.name[first])
        self.merged(first, name, low[first], high[last])


def word_seeds(units: Units, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of each window's seed; a window that decides no symbol (within a long run) is its own seed."""
    s = Symbols(units)
    s.runs()
    for i in range(PAIR_ROUNDS):
        s.pairs(0x5851F42D4C957F2D * (i + 1) & (2**64 - 1))
    # contexts begin and end in ascending order within a row; those that leave their row never lie in a window
    usable = np.flatnonzero((s.low >= 0) & (s.high <= len(units.codes)))
    low, high = s.low[usable], s.high[usable]
    p = prefix(units.codes)
    own = slices(p, low, high)
    first, last = np.searchsorted(low, starts), np.searchsorted(high, starts + WINDOW, side="right")
    some = last > first
    table = [(own & ~np.uint64(0xFFFFFFFF)) | np.arange(len(own), dtype=np.uint64)]
    while len(table[-1]) > 1 << (len(table) - 1) and len(table) < 5:
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    place, key = -1 - starts, slices(p, starts, starts + WINDOW)
    at, f, n = np.flatnonzero(some), first[some], (last - first)[some]
    level = np.minimum(np.floor(np.log2(np.maximum(n, 1))).astype(np.int64), len(table) - 1)
    for k in range(len(table)):
        here = level == k
        if here.any():
            i, x, m = at[here], f[here], n[here]
            least = np.minimum(table[k][x], table[k][x + m - (1 << k)])
            chosen = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            place[i], key[i] = chosen, own[chosen]
    return place, key


SCHEME = Scheme(WINDOW, word_units, word_seeds, same_doc=False)


def kept_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches):
        raw, off = text_bytes(b.column("text"))
        words = Words(raw, off, SPACE_WORDS)
        removed, kept = [], []
        for r, (s, n) in enumerate(zip(b.column("starts").to_pylist(), b.column("sizes").to_pylist(), strict=True)):
            i, j = int(words.row_at[r]), int(words.row_at[r + 1])
            at, pieces, gone = i, [], 0
            for x, y in zip(*(z.tolist() for z in merged_runs(s, n, WINDOW)), strict=True):
                pieces.append(words.joined(at, i + x))
                at, gone = i + y, gone + y - x
            pieces.append(words.joined(at, j))
            removed.append(gone)
            kept.append(b" ".join([p for p in pieces if p]).decode())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by a space) of each row of `docs`.

    A word goes if a 13-word window that covers it also starts in a document of a smaller doc_id. Null text has no
    words. Rows that share a doc_id are copies of one document and remove nothing from each other; with a null
    doc_id nothing is compared, and all words stay.
    """
    spark = docs.sparkSession
    with passing() as kept:
        base = bucketed(texts(docs), "doc_id", "recompression_texts")
        slot_ids = slots(spark)
        named = dealt(base.where("doc_id is not null"), send_families(SCHEME, slot_ids), SENT_FAMILIES)
        found = stored(dealt(named, match_families(SCHEME.same_doc, slot_ids), FOUND).mapInArrow(by_document(FOUND), PER_DOC), "recompression-found")
        repeats = repeated_runs(base, found, SCHEME)
        kept += [base, repeats]
    return with_runs(base, repeats).mapInArrow(kept_words, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
