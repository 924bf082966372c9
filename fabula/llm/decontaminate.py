"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Documents stream their words through the automaton, which tracks the longest suffix of what was read that occurs
in some item. Where that length reaches the window, the matched words are hit. Only stretches whose every
neighbouring pair of words occurs in some item enter the automaton; a window can lie nowhere else.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm.shared import stored, texts
from fabula.llm.textkit import ALNUM_WORDS, LOWER, Words, find_sorted, mix, parts, spans, text_bytes

WINDOW = 10
#: Item bytes in one automaton; a larger benchmark is dealt to several, through which documents stream in turn.
AUTOMATON_BYTES = 4 << 20


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


class ItemAutomaton:
    """The generalised suffix automaton of item word sequences, and the items in which each window occurs."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.window = window
        # most states have one way on: its word and its end lie in arrays, the others' further ways in dictionaries
        self.word, self.to, self.link, self.length = (array("q", [x]) for x in (-1, -1, -1, 0))
        self.more: dict[int, dict[int, int]] = {}
        column = pa.array([t for _, t in items], pa.string())
        raw, off = text_bytes(column)
        words = Words(LOWER[raw], off, ALNUM_WORDS)
        hashes = words.hashes()
        self.vocabulary, at = np.unique(hashes, return_index=True)
        self.spelled = [words.joined(i, i + 1) for i in at.tolist()]
        ids = find_sorted(hashes, self.vocabulary)
        sequences = [(item, ids[i:j].tolist()) for (item, _), i, j in zip(items, words.row_at[:-1], words.row_at[1:], strict=True) if j > i]
        rows = words.rows()
        same = rows[1:] == rows[:-1]
        self.pairs = np.unique(pair_hash(hashes[:-1][same], hashes[1:][same]))
        #: Words that are whole items, and the shortest window.
        self.single = np.unique(np.array([s[0] for _, s in sequences if len(s) == 1], np.int64))
        self.least = min((min(window, len(s)) for _, s in sequences), default=window)
        for _, s in sequences:
            self._add(s)
        #: By state: the lengths at which its suffix is a window, and the items that hold it.
        self.windows: dict[int, dict[int, set[int]]] = {}
        for item, s in sequences:
            n = min(window, len(s))
            state = length = 0
            for w in s:
                state, length = self.step(state, length, w)
                if length >= n:
                    self.windows.setdefault(self._holder(state, n), {}).setdefault(n, set()).add(item)

    def _add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def way(self, state: int, w: int) -> int:
        """Where word `w` leads from a state, or -1."""
        if self.word[state] == w:
            return self.to[state]
        return self.more[state].get(w, -1) if state in self.more else -1

    def _set(self, state: int, w: int, to: int) -> None:
        if self.word[state] in (-1, w):
            self.word[state], self.to[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _new(self, length: int, link: int, like: int = -1) -> int:
        """A state without ways on, or with those of `like`."""
        new = len(self.word)
        self.word.append(self.word[like] if like >= 0 else -1)
        self.to.append(self.to[like] if like >= 0 else -1)
        if like in self.more:
            self.more[new] = dict(self.more[like])
        self.link.append(link)
        self.length.append(length)
        return new

    def _split(self, p: int, w: int) -> int:
        """The state that `p` reaches by `w` with length exactly one more, split off if need be."""
        q = self.way(p, w)
        if self.length[q] == self.length[p] + 1:
            return q
        c = self._new(self.length[p] + 1, self.link[q], q)
        self.link[q] = c
        while p >= 0 and self.way(p, w) == q:
            self._set(p, w, c)
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        if self.way(last, w) >= 0:
            return self._split(last, w)
        new, p = self._new(self.length[last] + 1, 0), last
        while p >= 0 and self.way(p, w) < 0:
            self._set(p, w, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """The longest suffix, after `w`, that occurs in an item."""
        while (to := self.way(state, w)) < 0 and state:
            state = self.link[state]
            length = self.length[state]
        return (to, length + 1) if to >= 0 else (0, 0)

    def _holder(self, state: int, n: int) -> int:
        """The suffix state that represents the last n words."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def scan(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit ranges of a stretch of word ids, and the items whose windows occur in it."""
        state = length = 0
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        for j, w in enumerate(words):
            state, length = self.step(state, length, w)
            if length < self.least:
                continue
            s, longest = state, 0
            while s > 0:  # shorter suffixes may be short items
                for n, own in self.windows.get(s, {}).items():
                    if n <= length:
                        items |= own
                        longest = max(longest, n)
                s = self.link[s]
            if longest:
                found.append((j + 1 - longest, j + 1))
        return found, items


RANGES = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def find_hits(docs: DataFrame, items: list[tuple[int, str]], window: int) -> DataFrame:
    """`docs` (with text, hits, items and any others) with the hits and items of one more automaton added.

    hits are byte ranges of runs of hit words. A map over partitions.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(ItemAutomaton(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton.value
        single = np.zeros(len(auto.vocabulary) + 1, bool)
        single[auto.single] = True
        for b in parts(batches):
            raw, off = text_bytes(b.column("text"))
            words = Words(LOWER[raw], off, ALNUM_WORDS)
            hashes = words.hashes()
            hit = np.zeros(len(words), bool)
            found: dict[int, set[int]] = {}
            for r, (ranges, own) in enumerate(zip(b.column("hits").to_pylist(), b.column("items").to_pylist(), strict=True)):
                if own:
                    found[r] = set(own)
                for x in ranges:
                    hit[np.searchsorted(words.starts, off[r] + x["s"]) : np.searchsorted(words.starts, off[r] + x["e"])] = True
            if len(words) and len(auto.vocabulary):
                rows = words.rows()
                s, e = spans((find_sorted(pair_hash(hashes[:-1], hashes[1:]), auto.pairs) >= 0) & (rows[1:] == rows[:-1]))
                keep = e - s + 1 >= auto.least
                stretches = list(zip(s[keep].tolist(), (e[keep] + 1).tolist(), strict=True))
                if len(auto.single):  # a lone word can be a window of its own
                    ids = find_sorted(hashes, auto.vocabulary)
                    stretches += [(i, i + 1) for i in np.flatnonzero(single[ids] & (ids >= 0)).tolist()]
                for i, j in stretches:
                    own = find_sorted(hashes[i:j], auto.vocabulary).tolist()
                    # a word counts only if it is spelled as the item's word of the same hash
                    own = [w if w >= 0 and words.joined(k, k + 1) == auto.spelled[w] else -2 for k, w in enumerate(own, i)]
                    ranges, here = auto.scan(own)
                    for x, y in ranges:
                        hit[i + x : i + y] = True
                    if here:
                        found.setdefault(int(rows[i]), set()).update(here)
            total = np.concatenate(([0], np.cumsum(hit)))
            n_hit = total[words.row_at[1:]] - total[words.row_at[:-1]]
            out: list[list[dict[str, int]]] = [[] for _ in range(b.num_rows)]
            for r in np.flatnonzero(n_hit).tolist():
                i, j = words.row_at[r], words.row_at[r + 1]
                out[r] = [{"s": int(words.starts[i + x] - off[r]), "e": int(words.ends[i + y - 1] - off[r])} for x, y in zip(*spans(hit[i:j]), strict=True)]
            new = {"n_words": pa.array(words.counts, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "hits": pa.array(out, RANGES), "items": pa.array([sorted(found.get(r, ())) for r in range(b.num_rows)], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([new.get(n, c) for n, c in zip(b.schema.names, b.columns, strict=True)], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def contamination(base: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """`base` (with a text that is not null, and any other columns but the added ones) and n_words, n_hit, hits, items.

    Items of fewer words than the window are windows themselves; items without words, or null, are none. Items
    beyond `automaton_bytes` go to further automata, one after the other, so that a task holds only one at a
    time; documents stream through each, and the hits are united. Repeated rows give repeated rows.
    """
    types = dict(zip(("n_words", "n_hit", "hits", "items"), ("long", "long", "array<struct<s:long,e:long>>", "array<long>"), strict=True))
    out = base.select("*", *[(F.array() if t.startswith("array") else F.lit(0)).cast(t).alias(n) for n, t in types.items()])
    shard: list[tuple[int, str]] = []
    size = passed = 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("item_id is not null and text is not null")
    for row in rows.toLocalIterator():
        shard.append((row.item_id, row.text))
        size += len(row.text.encode())
        if size > automaton_bytes:
            out = stored(find_hits(out, shard, window), "hits")
            shard, size, passed = [], 0, passed + 1
    return find_hits(out, shard, window) if shard or not passed else out


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of `docs`. Null text has no words.

    A null doc_id stays null; repeated rows give repeated rows; other columns are never looked at; texts are read whole.
    """
    found = contamination(texts(docs), benchmark, window)
    joined = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def cut_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, hits in zip(b.column("text").to_pylist(), b.column("hits").to_pylist(), strict=True):
            if hits:
                raw, at, kept = text.encode(), 0, []
                for x in hits:
                    kept.append(raw[at : x["s"]])
                    at = x["e"]
                text = b"".join([*kept, raw[at:]]).decode()
            out.append(text)
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.string())], names=["row", "text"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_coverage: float = 0.5) -> DataFrame:
    """`docs` with hit spans cut out of their texts; documents of which more than `drop_coverage` of the words are hit go.

    All columns stay, in their order; rows without hits are returned as they are, null texts too. Nothing is shuffled.
    """
    fields = docs.schema.fields
    row = F.struct(*[(F.col(f.name).isNull() if f.name == "text" else F.col(f.name)).alias(f"c{i}") for i, f in enumerate(fields)])
    found = contamination(docs.select(F.coalesce("text", F.lit("")).alias("text"), row.alias("row")), benchmark, window)
    kept = found.where(F.col("n_hit") <= drop_coverage * F.col("n_words")).select("row", "text", "hits")
    cut = kept.mapInArrow(cut_hits, kept.drop("hits").schema)
    return cut.select(*[(F.when(~F.col(f"row.c{i}"), F.col("text")) if f.name == "text" else F.col(f"row.c{i}")).alias(f.name) for i, f in enumerate(fields)])
