"""Substring dedup by a logarithmic family of suffix arrays.

A batch's array holds suffixes sampled by content (minimizers: of the places where a 100-byte window's least-hashed
GRAM-byte string begins), in the order of the hash of their first GRAM bytes, so equal beginnings stand side by side. A
new batch is scanned against each level of the index, both in their order, for suffixes that agree; the agreeing ones
are extended to whole windows. Levels of equal size merge, as sorted runs, so n batches lie in about log2(n) levels.
Arrays are dealt to slots by hash and stored in buckets of the slot.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm import packed
from fabula.llm.repeats import FAMILIES, FOUND, PER_DOC, SENT_FAMILIES, Scheme, Units, by_document, found_rows, merged_runs, repeated_runs, send_families, shared_only, sorted_families, with_runs
from fabula.llm.shared import bucketed, passing, slots, stored, tasks, texts
from fabula.llm.textkit import CODES, parts, prefix, slices, text_bytes

WIDTH, GRAM = 100, 24
#: Parts, by ranges of doc_id, in which a table goes into the index.
BATCHES = 4


def byte_units(raw: np.ndarray, off: np.ndarray) -> Units:
    return Units(CODES[0][raw], off, CODES[1][raw])


def byte_seeds(units: Units, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the leftmost least-hashed GRAM-byte string of each window."""
    at = np.arange(len(units.codes) - GRAM + 1)
    h = slices(prefix(units.codes), at, at + GRAM)
    least = (h & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)
    width, reach = WIDTH - GRAM + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    place = (np.minimum(least[starts], least[starts + width - reach]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return place, h[place]


SCHEME = Scheme(WIDTH, byte_units, byte_seeds, same_doc=True)


Entries = dict[str, np.ndarray]


def one_array(got: Entries, slot: int) -> pa.Table:
    return pa.table({"slot": pa.array([slot], pa.int32()), **{n: pa.array([got[n].tobytes() if n in got else b""], pa.binary()) for n in SENT_FAMILIES}})


def split(table: pa.Table, planes: dict[str, type]) -> tuple[Entries, pa.Table]:
    """The entries of an array, and the given planes of the rows that were settled before they came to it."""
    sent: list[pa.RecordBatch] = []
    kind = pa.schema([("slot", pa.int32()), *[(n, pa.binary()) for n in planes]])
    rows = pa.Table.from_batches([b.cast(kind) for b in packed.settled(table.to_batches(), "seeds", planes, sent)], kind)
    return packed.gather(iter(sent), FAMILIES), rows


def gathered(table: pa.Table) -> Entries:
    return split(table, FOUND)[0]


def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The sorted array of one slot, and what was settled before."""
    got, rows = split(table, SENT_FAMILIES)
    order = np.argsort(got["seeds"], kind="stable")
    return pa.concat_tables([one_array({n: x[order] for n, x in got.items()}, key[0].as_py()), rows])


def merged_arrays(a: Entries, b: Entries) -> Entries:
    """Two sorted arrays as one: each entry's place is its own and the number of the other array's entries before it."""
    at_a = np.arange(len(a["seeds"])) + np.searchsorted(b["seeds"], a["seeds"], side="left")
    at_b = np.arange(len(b["seeds"])) + np.searchsorted(a["seeds"], b["seeds"], side="right")
    out = {}
    for n in a:
        x = np.empty(len(at_a) + len(at_b), a[n].dtype)
        x[at_a], x[at_b] = a[n], b[n]
        out[n] = x
    return out


def merge(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    return one_array(merged_arrays(gathered(left), gathered(right)), key[0].as_py())


def scanned(new: Entries, old: Entries) -> Entries:
    """The entries of two sorted arrays that begin like one of the other's."""
    found = []
    for x, y in ((new, old), (old, new)):
        at = np.flatnonzero(np.searchsorted(y["seeds"], x["seeds"], side="left") < np.searchsorted(y["seeds"], x["seeds"], side="right"))
        found.append({n: c[at] for n, c in x.items()})
    return {n: np.concatenate([found[0][n], found[1][n]]) for n in new}


def agreeing(by_doc: list[int], got: Entries) -> pa.Table:
    rows = list(found_rows(sorted_families(got), SCHEME.same_doc, by_doc))
    empty = pa.schema([("slot", pa.int32()), *[(n, pa.binary()) for n in FOUND]])
    return pa.Table.from_batches([b.cast(empty) for b in rows], empty)


def agreeing_within(by_doc: list[int], table: pa.Table) -> pa.Table:
    """What the entries of one array have in common, and what was settled before."""
    got, rows = split(table, FOUND)
    return pa.concat_tables([rows, agreeing(by_doc, shared_only(got, "seeds"))])


@dataclass
class Level:
    batches: int
    table: str


class SuffixIndex:
    """Levels of stored arrays, the largest first."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[Level] = []
        self.slots = slots(spark)

    def _store(self, arrays: DataFrame) -> str:
        name = f"suffix_level_{uuid.uuid4().hex}"
        arrays.write.bucketBy(tasks(self.spark), "slot").saveAsTable(name)
        return name

    def add(self, base: DataFrame, keep: bool = True) -> list[DataFrame]:
        """Puts a batch (doc_id, text; both not null) in and returns what it has in common with itself and each level.

        The last batch of a family that is not used again need not be kept.
        """
        by_doc = self.slots
        arrays = base.mapInArrow(send_families(SCHEME, self.slots), packed.schema(SENT_FAMILIES)).groupBy("slot").applyInArrow(build, packed.schema(SENT_FAMILIES))
        name = self._store(arrays)
        arrays = self.spark.table(name)
        out = [arrays.groupBy("slot").applyInArrow(lambda table: agreeing_within(by_doc, table), packed.schema(FOUND))]

        def scan(new: pa.Table, old: pa.Table) -> pa.Table:
            return agreeing(by_doc, scanned(gathered(new), gathered(old)))

        for level in self.levels:
            out.append(arrays.groupBy("slot").cogroup(self.spark.table(level.table).groupBy("slot")).applyInArrow(scan, packed.schema(FOUND)))
        out = [stored(x, "suffix-agreements") for x in out]  # before levels merge
        if not keep:
            self.spark.sql(f"drop table {name}")
            return out
        self.levels.append(Level(1, name))
        while len(self.levels) > 1 and self.levels[-1].batches == self.levels[-2].batches:
            a, b = self.levels[-2:]
            both = self.spark.table(a.table).groupBy("slot").cogroup(self.spark.table(b.table).groupBy("slot")).applyInArrow(merge, packed.schema(SENT_FAMILIES))
            self.levels[-2:] = [Level(a.batches + b.batches, self._store(both))]
            for x in (a, b):
                self.spark.sql(f"drop table {x.table}")
        return out

    def drop(self) -> None:
        """Removes all levels."""
        for level in self.levels:
            self.spark.sql(f"drop table {level.table}")
        self.levels = []


def kept_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches):
        raw, off = text_bytes(b.column("text"))
        removed, spans, digest, kept = [], [], [], []
        for r, (s, n) in enumerate(zip(b.column("starts").to_pylist(), b.column("sizes").to_pylist(), strict=True)):
            own = raw[off[r] : off[r + 1]]
            mask = np.ones(len(own), bool)
            runs = list(zip(*(z.tolist() for z in merged_runs(s, n, WIDTH)), strict=True))
            for x, y in runs:
                mask[x:y] = False
            left = own[mask].tobytes() if runs else own.tobytes()
            removed.append(len(own) - len(left))
            spans.append(len(runs))
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) of each row of `docs`.

    A byte goes if a 100-byte string that covers it also starts earlier: in a smaller doc_id, or before in the same
    document. Null text is empty. Rows that share a doc_id are copies of one document and remove nothing from each
    other; with a null doc_id nothing is compared, and all bytes stay.
    """
    spark = docs.sparkSession
    with passing() as kept:
        base = bucketed(texts(docs), "doc_id", "suffix_texts")
        real = base.where("doc_id is not null")
        cuts = real.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
        bounds = [-(2**63), *[int(c) for c in cuts], 2**63 - 1] if len(cuts) == batches - 1 else [-(2**63), 2**63 - 1]
        index, agreements = SuffixIndex(spark), []
        for i in range(len(bounds) - 1):
            above = F.col("doc_id") > bounds[i] if i else F.lit(True)
            agreements += index.add(real.where(above & (F.col("doc_id") <= bounds[i + 1])), keep=i < len(bounds) - 2)
        index.drop()
        found = agreements[0]
        for x in agreements[1:]:
            found = found.unionByName(x)
        found = stored(found.repartition(tasks(spark), "slot").mapInArrow(by_document(FOUND), PER_DOC), "suffix-found")
        repeats = repeated_runs(base, found, SCHEME)
        kept += [base, repeats]
    return with_runs(base, repeats).mapInArrow(kept_bytes, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
