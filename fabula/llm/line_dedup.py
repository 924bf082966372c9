"""Line dedup by content-defined chunks of lines.

A chunk begins, and one ends, at every line: the fewest lines that make a passage. So every passage that sits elsewhere
in another text is covered by the same chunks there, wherever it stands and whatever its neighbours are. Chunks meet by
their hashes; those of a document that repeat one earlier place side by side are joined to a run of lines as long as the
texts agree, and the run is compared with that place byte by byte, and goes if equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm import packed
from fabula.llm.firsts import Firsts
from fabula.llm.repeats import shared_only
from fabula.llm.shared import bucketed, slots, stored, tasks, texts
from fabula.llm.textkit import Words, mix, parts, range_hashes, text_bytes

#: Fewer lines, or bytes, are no passage and stay.
LEAST_LINES, LEAST_BYTES = 2, 40

CHUNKS = {"high": np.uint64, "low": np.uint64, "docs": np.int64, "starts": np.uint32, "sizes": np.uint32}
REPEATS = {"docs": np.int64, "starts": np.uint32, "sizes": np.uint32, "of": np.int64, "at": np.uint32}
SENT = CHUNKS | REPEATS

NOT_BREAK = np.ones(256, bool)
NOT_BREAK[10] = False


def chunks(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte, end byte and number of lines of each chunk; empty lines belong to no chunk's count.

    From each line down, and from each line up, a chunk takes the fewest lines of its row that are LEAST_LINES and
    LEAST_BYTES; what fits neither way makes none. A chunk runs from its first line that is not empty to its last one,
    line breaks between them included. Chunks overlap, and ascend by their first and by their end byte.

    Every line of a passage is in a chunk within the passage: the one that begins there, or, where too little of the
    passage follows, the one that ends with it.
    """
    lines = Words(raw, off, NOT_BREAK)
    n = len(lines)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    row, at = lines.rows(), np.arange(n)
    down = np.maximum(np.searchsorted(lines.ends, lines.starts + LEAST_BYTES), at + LEAST_LINES - 1)
    up = np.minimum(np.searchsorted(lines.starts, lines.ends - LEAST_BYTES, side="right") - 1, at - LEAST_LINES + 1)
    first, end = np.append(at, up), np.append(down, at)
    inside = (first >= 0) & (end < n)
    first, end = first[inside], end[inside]
    own = row[first] == row[end]
    first, end = np.divmod(np.unique(first[own] * n + end[own]), n)
    return row[first], lines.starts[first], lines.ends[end], end - first + 1


def send_chunks(slot_ids: list[int]):
    """Chunks dealt by their hash; those that repeat one of the same task are dealt by document, with that one's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = Firsts(same_doc=True)
        for b in parts(batches):
            raw, off = text_bytes(b.column("text"))
            row, s, e, _ = chunks(raw, off)
            if not len(row):
                continue
            high, low = (range_hashes(raw, s, e, i) for i in (0, 1))
            f = {"high": high, "low": low, "docs": b.column("doc_id").to_numpy()[row], "starts": (s - off[row]).astype(np.uint32), "sizes": (e - s).astype(np.uint32)}
            again, of, at = firsts.judge(high, low, f["docs"], f["starts"])
            if not again.all():
                yield packed.deal(slot_ids, high[~again], {n: x[~again] for n, x in f.items()}, SENT)
            if again.any():
                docs = f["docs"][again]
                yield packed.deal(slot_ids, mix(docs.view(np.uint64)), {"docs": docs, "starts": f["starts"][again], "sizes": f["sizes"][again], "of": of[again], "at": at[again]}, SENT)

    return run


def match_chunks(by_doc: list[int]):
    """Chunks that repeat the first of their hash (smallest doc_id, then start), with its place, or an earlier one of their own task; dealt by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: list[pa.RecordBatch] = []
        yield from packed.settled(batches, "high", REPEATS, sent)
        f = shared_only(packed.gather(iter(sent), CHUNKS), "high")
        order = np.lexsort((f["starts"], f["docs"], f["low"], f["high"]))
        f = {n: x[order] for n, x in f.items()}
        if not len(order):
            return
        new = np.append(True, (f["high"][1:] != f["high"][:-1]) | (f["low"][1:] != f["low"][:-1]))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = (f["docs"] != f["docs"][head]) | (f["starts"] != f["starts"][head])
        if again.any():
            docs = f["docs"][again]
            yield packed.deal(by_doc, mix(docs.view(np.uint64)), {"docs": docs, "starts": f["starts"][again], "sizes": f["sizes"][again], "of": f["docs"][head][again], "at": f["starts"][head][again]})

    return run


def runs(got: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Overlapping repeats of one document that lie in another, or earlier in itself, as far from each other, as one."""
    if not len(got["docs"]):
        return got
    order = np.lexsort((got["sizes"], got["starts"], got["docs"]))
    f = {n: x[order].astype(np.int64) for n, x in got.items()}
    ends, shift = f["starts"] + f["sizes"], f["starts"] - f["at"]
    new = np.ones(len(order), bool)
    new[1:] = (f["docs"][1:] != f["docs"][:-1]) | (f["of"][1:] != f["of"][:-1]) | (shift[1:] != shift[:-1]) | (f["starts"][1:] > ends[:-1])
    first = np.flatnonzero(new)
    return {"docs": f["docs"][first], "starts": f["starts"][first], "sizes": np.maximum.reduceat(ends, first) - f["starts"][first], "of": f["of"][first], "at": f["at"][first]}


def by_source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, size, of, at) rows of runs."""
    got = runs(packed.gather(batches, REPEATS))
    for i in range(0, len(got["docs"]), 50_000):
        cut = slice(i, i + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(got["docs"][cut]), *[pa.array(got[n][cut].astype(np.int64)) for n in ("starts", "sizes", "of", "at")]], names=["doc_id", "start", "size", "of", "at"])


def cut_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the runs whose bytes equal those they repeat; one line break goes with each, and what then touches counts as one."""
    for b in parts(batches):
        kept, removed, gone = [], [], []
        for text, rows in zip(b.column("text").to_pylist(), b.column("rows").to_pylist(), strict=True):
            raw = (text or "").encode()
            ranges = sorted({(x["start"], x["start"] + x["size"]) for x in rows or () if raw[x["start"] : x["start"] + x["size"]] == x["first"][: x["size"]]})
            cuts: list[list[int]] = []
            for s, e in ranges:
                after = e + 1 if raw[e : e + 1] == b"\n" else e
                if cuts and s <= cuts[-1][1]:
                    cuts[-1][1] = max(after, cuts[-1][1])
                else:
                    cuts.append([s, after])
            at, pieces, lines = 0, [], 0
            for s, e in cuts:
                pieces.append(raw[at:s])
                at = e
                lines += sum(1 for x in raw[s:e].split(b"\n") if x)
            pieces.append(raw[at:])
            kept.append(b"".join(pieces).decode())
            removed.append(len(cuts))
            gone.append(lines)
        yield pa.RecordBatch.from_arrays([b.column("row_key"), pa.array(kept, pa.string()), pa.array(removed, pa.int64()), pa.array(gone, pa.int64())], names=["row_key", "kept", "chunks_removed", "lines_removed"])


def repeated_chunks(base: DataFrame) -> DataFrame:
    """doc_id, rows array<struct<start,size,first>>: of the bucketed table `base`, runs that repeat earlier chunks, with the bytes there (of the longest run that begins there)."""
    spark = base.sparkSession
    slot_ids = slots(spark)

    def dealt(df: DataFrame, run, planes: dict[str, type]) -> DataFrame:
        return df.mapInArrow(run, packed.schema(planes)).repartition(tasks(spark), "slot")

    named = dealt(base.where("doc_id is not null"), send_chunks(slot_ids), SENT)
    found = stored(dealt(named, match_chunks(slot_ids), REPEATS).mapInArrow(by_source, "doc_id long, start long, size long, of long, at long"), "line-repeats")
    # the bytes of each repeated place, once
    firsts = found.groupBy("of", "at").agg(F.max("size").alias("size")).groupBy("of").agg(F.collect_list(F.struct("at", "size")).alias("places"))
    read = base.join(firsts.withColumnRenamed("of", "doc_id"), "doc_id").select(F.col("doc_id").alias("of"), F.col("text").cast("binary").alias("raw"), F.explode("places").alias("p"))
    first = stored(read.select("of", F.col("p.at").alias("at"), F.substring("raw", (F.col("p.at") + 1).cast("int"), F.col("p.size").cast("int")).alias("first")).dropDuplicates(["of", "at"]), "line-firsts")
    # a repeat gets as many bytes as it has itself, not those of the longest one of its place
    own = found.join(first, ["of", "at"]).select("doc_id", "start", "size", F.substring("first", F.lit(1), F.col("size").cast("int")).alias("first"))
    return own.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size", "first")).alias("rows"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, chunks_removed, lines_removed, kept, kept_sha256 of each row of `docs`.

    Lines that are not empty count. Every passage of at least LEAST_LINES lines and LEAST_BYTES bytes goes, with one
    line break, if its bytes also are whole lines earlier (in a smaller doc_id, or from an earlier line of the same
    document); `chunks_removed` counts the runs of lines that went. Null text is empty. Rows that share a doc_id are copies of one document; with a null doc_id nothing is compared.
    """
    base = bucketed(texts(docs), "doc_id", "line_texts")
    work = base.join(repeated_chunks(base), "doc_id", "left").select(F.struct("doc_id", (F.size(F.filter(F.split("text", "\n"), lambda x: x != ""))).cast("long").alias("n_lines")).alias("row_key"), "text", "rows")
    out = work.mapInArrow(cut_chunks, "row_key struct<doc_id:long,n_lines:long>, kept string, chunks_removed long, lines_removed long")
    return out.select("row_key.doc_id", "row_key.n_lines", "chunks_removed", "lines_removed", "kept", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with repeated passages cut out of their texts; all rows and columns stay, null texts too."""
    fields = docs.schema.fields
    row = F.struct(*[(F.col(f.name).isNull() if f.name == "text" else F.col(f.name)).alias(f"c{i}") for i, f in enumerate(fields)])
    base = bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), row.alias("row_key")), "doc_id", "line_texts")
    work = base.join(repeated_chunks(base.select("doc_id", "text")), "doc_id", "left").select("row_key", "text", "rows")
    kind = work.schema["row_key"].dataType.simpleString()
    out = work.mapInArrow(cut_chunks, f"row_key {kind}, kept string, chunks_removed long, lines_removed long")
    return out.select(*[(F.when(~F.col(f"row_key.c{i}"), F.col("kept")) if f.name == "text" else F.col(f"row_key.c{i}")).alias(f.name) for i, f in enumerate(fields)])
