"""Windows that occur before: what substring removal by suffixes and by recompression have in common.

A text is a sequence of units (bytes or words). Every window of `width` units has a seed, a piece inside it that
the window's content alone decides; neighbouring windows with one seed are a family, and what a family covers is
its span. Families meet by their seeds' hashes. Of families with equal spans all but the first repeat as wholes; a
task settles those it has seen before itself, and sends no more of a seed when its slot must know of several spans.
Where a seed has several spans, their windows are hashed one by one and meet by those hashes. So only seeds and
few windows are moved, and texts not at all: they are stored once in buckets of doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm import packed
from fabula.llm.firsts import Firsts, Wide
from fabula.llm.shared import slots, stored, tasks
from fabula.llm.textkit import mix, parts, prefix, slices, text_bytes

FAMILIES = {"seeds": np.uint64, "spans": np.uint64, "docs": np.int64, "starts": np.uint32, "sizes": np.uint32}
FOUND = {"docs": np.int64, "starts": np.uint32, "sizes": np.uint32, "open": np.uint8}
WINDOWS = {"high": np.uint64, "low": np.uint32, "docs": np.int64, "starts": np.uint32}
RUNS = {"docs": np.int64, "starts": np.uint32, "sizes": np.uint32}
#: What is sent: entries to be matched, dealt by their key, and settled ones, dealt by document, without a key.
SENT_FAMILIES, SENT_WINDOWS = FAMILIES | FOUND, WINDOWS | RUNS


@dataclass
class Units:
    """Two independent codes of a batch's units, and where each row's units begin; row r has at[r] : at[r + 1]."""

    codes: np.ndarray
    at: np.ndarray
    others: np.ndarray

    def plane(self, which: int) -> np.ndarray:
        return self.others if which else self.codes


@dataclass
class Scheme:
    """How windows are formed: their width, how texts become units, and the seed of each window.

    `seed(units, starts)` gives for window starts (ascending) the place and the hash of the seed.
    """

    width: int
    units: Callable[[np.ndarray, np.ndarray], Units]
    seed: Callable[[Units, np.ndarray], tuple[np.ndarray, np.ndarray]]
    same_doc: bool  # whether an earlier window of the same document counts


def families(scheme: Scheme, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start within the row, number of windows, seed hash and span hash of each family."""
    n = np.maximum(np.diff(units.at) - scheme.width + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    starts = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + units.at[:-1][row]
    if not len(starts):
        return row, starts, n[:0], np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    place, key = scheme.seed(units, starts)
    new = np.ones(len(row), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(row)))
    span = slices(prefix(units.others, 1), starts[first], starts[first] + size - 1 + scheme.width, 1)
    return row[first], starts[first] - units.at[row[first]], size, key[first], span


def send_families(scheme: Scheme, slot_ids: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, wide = Firsts(scheme.same_doc), Wide()
        for b in parts(batches):
            row, start, size, seed, span = families(scheme, scheme.units(*text_bytes(b.column("text"))))
            if not len(row):
                continue
            f = {"seeds": seed, "spans": span, "docs": b.column("doc_id").to_numpy()[row], "starts": start.astype(np.uint32), "sizes": size.astype(np.uint32)}
            again, _, _ = firsts.judge(seed, span, f["docs"], f["starts"])
            look = np.zeros(len(row), bool)
            look[~again] = wide.beyond(seed[~again], span[~again])
            done = again | look
            if not done.all():
                yield packed.deal(slot_ids, seed[~done], {n: x[~done] for n, x in f.items()}, SENT_FAMILIES)
            if done.any():
                docs = f["docs"][done]
                yield packed.deal(slot_ids, mix(docs.view(np.uint64)), {"docs": docs, "starts": f["starts"][done], "sizes": f["sizes"][done], "open": look[done].astype(np.uint8)}, SENT_FAMILIES)

    return run


def sorted_families(got: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    order = np.lexsort((got["starts"], got["docs"], got["spans"], got["seeds"]))
    return {n: x[order] for n, x in got.items()}


def shared_only(got: dict[str, np.ndarray], key: str) -> dict[str, np.ndarray]:
    """The entries whose key occurs more than once."""
    order = np.argsort(got[key], kind="stable")
    k = got[key][order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    return {n: x[at] for n, x in got.items()}


def judged(f: dict[str, np.ndarray], same_doc: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted families: those that repeat as wholes, and those whose windows must be looked at."""
    seeds, spans, docs = f["seeds"], f["spans"], f["docs"]
    if not len(seeds):
        return np.zeros(0, bool), np.zeros(0, bool)
    new_seed = np.append(True, seeds[1:] != seeds[:-1])
    new_span = new_seed | np.append(True, spans[1:] != spans[:-1])
    head = np.flatnonzero(new_span)[np.cumsum(new_span) - 1]
    whole = (docs != docs[head]) | ((f["starts"] != f["starts"][head]) if same_doc else False)
    group = np.cumsum(new_seed) - 1
    several = np.bincount(group, weights=new_span) > 1
    return whole, ~whole & several[group]


def found_rows(f: dict[str, np.ndarray], same_doc: bool, by_doc: list[int]) -> Iterator[pa.RecordBatch]:
    whole, look = judged(f, same_doc)
    at = np.flatnonzero(whole | look)
    if len(at):
        docs = f["docs"][at]
        yield packed.deal(by_doc, mix(docs.view(np.uint64)), {"docs": docs, "starts": f["starts"][at], "sizes": f["sizes"][at], "open": look[at].astype(np.uint8)})


def match_families(same_doc: bool, by_doc: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: list[pa.RecordBatch] = []
        yield from packed.settled(batches, "seeds", FOUND, sent)
        yield from found_rows(sorted_families(shared_only(packed.gather(iter(sent), FAMILIES), "seeds")), same_doc, by_doc)

    return run


def by_document(planes: dict[str, type]):
    """Packed entries to rows of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = packed.gather(batches, planes)
        docs = got.pop("docs")
        if "open" in planes:
            # several batches may have judged one family: once is enough, and a whole repeat is the last word
            order = np.lexsort((got["open"], got["starts"], docs))
            docs, got = docs[order], {n: x[order] for n, x in got.items()}
            once = np.append(True, (docs[1:] != docs[:-1]) | (got["starts"][1:] != got["starts"][:-1]))[: len(docs)]
            docs, got = docs[once], {n: x[once] for n, x in got.items()}
            is_open = got.pop("open") == 1
            out = []
            for want in (False, True):
                at = is_open == want
                out.append((docs[at], {n: x[at] for n, x in got.items()}, want))
            for d, p, want in out:
                for b in packed.lists_by(d, p):
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, want))], names=[*b.schema.names, "open"])
        else:
            # single windows of a document to runs
            order = np.lexsort((got["starts"], docs))
            d, s = docs[order], got["starts"][order].astype(np.int64)
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(d)) - 1
            if len(first):
                for b in packed.lists_by(d[first], {"starts": s[first].astype(np.uint32), "sizes": (s[last] - s[first] + 1).astype(np.uint32)}):
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.zeros(b.num_rows, bool))], names=[*b.schema.names, "open"])

    return run


PER_DOC = "doc_id long, starts binary, sizes binary, open boolean"


def dealt(df: DataFrame, run, planes: dict[str, type]) -> DataFrame:
    return df.mapInArrow(run, packed.schema(planes)).repartition(tasks(df.sparkSession), "slot")


def send_windows(scheme: Scheme, slot_ids: list[int]):
    """Hashes of the windows of open families."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = Firsts(scheme.same_doc)
        for b in parts(batches):
            units = scheme.units(*text_bytes(b.column("text")))
            at = []
            row = []
            for r, (s, n) in enumerate(zip(b.column("starts").to_pylist(), b.column("sizes").to_pylist(), strict=True)):
                s, n = np.frombuffer(s, np.uint32).astype(np.int64), np.frombuffer(n, np.uint32).astype(np.int64)
                own = np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())
                at.append(own + units.at[r])
                row.append(np.full(len(own), r))
            x, row_of = np.concatenate(at), np.concatenate(row)
            high, low = (slices(prefix(units.plane(i), i), x, x + scheme.width, i) for i in (0, 1))
            f = {"high": high, "low": (low >> np.uint64(32)).astype(np.uint32), "docs": b.column("doc_id").to_numpy()[row_of], "starts": (x - units.at[row_of]).astype(np.uint32)}
            again, _, _ = firsts.judge(high, f["low"].astype(np.uint64), f["docs"], f["starts"])
            if not again.all():
                yield packed.deal(slot_ids, high[~again], {n: p[~again] for n, p in f.items()}, SENT_WINDOWS)
            if again.any():
                docs = f["docs"][again]
                yield packed.deal(slot_ids, mix(docs.view(np.uint64)), {"docs": docs, "starts": f["starts"][again], "sizes": np.ones(len(docs), np.uint32)}, SENT_WINDOWS)

    return run


def match_windows(same_doc: bool, by_doc: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: list[pa.RecordBatch] = []
        yield from packed.settled(batches, "high", RUNS, sent)
        f = shared_only(packed.gather(iter(sent), WINDOWS), "high")
        order = np.lexsort((f["starts"], f["docs"], f["low"], f["high"]))
        f = {n: x[order] for n, x in f.items()}
        if not len(order):
            return
        new = np.ones(len(order), bool)
        new[1:] = (f["high"][1:] != f["high"][:-1]) | (f["low"][1:] != f["low"][:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        gone = (f["docs"] != f["docs"][head]) | ((f["starts"] != f["starts"][head]) if same_doc else False)
        if gone.any():
            docs = f["docs"][gone]
            yield packed.deal(by_doc, mix(docs.view(np.uint64)), {"docs": docs, "starts": f["starts"][gone], "sizes": np.ones(len(docs), np.uint32)})

    return run


def merged_runs(starts: list[bytes] | None, sizes: list[bytes] | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of units covered by windows that begin in the given runs of starts."""
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s, n = (np.frombuffer(b"".join(x), np.uint32).astype(np.int64) for x in (starts, sizes))
    order = np.argsort(s, kind="stable")
    s, e = s[order], (s + n - 1 + width)[order]
    e = np.maximum.accumulate(e)
    new = np.append(True, s[1:] > e[:-1])
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:], len(s)) - 1]


def repeated_runs(base: DataFrame, found: DataFrame, scheme: Scheme) -> DataFrame:
    """(doc_id, starts, sizes), stored: packed runs of repeated windows. `found` (PER_DOC) is what matching seeds said of the families of `base`."""
    slot_ids = slots(base.sparkSession)
    look = found.where("open").select("doc_id", "starts", "sizes")
    windows = dealt(base.join(look, "doc_id"), send_windows(scheme, slot_ids), SENT_WINDOWS)
    gone = dealt(windows, match_windows(scheme.same_doc, slot_ids), RUNS).mapInArrow(by_document(RUNS), PER_DOC)
    return stored(found.where("not open").unionByName(gone).select("doc_id", "starts", "sizes"), "repeats")


def with_runs(base: DataFrame, repeats: DataFrame) -> DataFrame:
    """doc_id, text, starts, sizes (arrays of packed runs, null where none) of each row of `base`, the bucketed table of texts."""
    runs = repeats.groupBy("doc_id").agg(F.collect_list(F.struct("starts", "sizes")).alias("runs")).select("doc_id", F.col("runs.starts").alias("starts"), F.col("runs.sizes").alias("sizes"))
    return base.join(runs, "doc_id", "left").select("doc_id", "text", "starts", "sizes")
