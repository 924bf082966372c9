"""Exact top-k by inner product in three phases with a uniform threshold.

Vectors are cut into blocks of components; a block's partial products with a query are one score list. Phase one
gathers the head of every list and resolves the totals of what is in them: the k-th best total is a safe cutoff,
for no result can be below it. Phase two broadcasts the cutoff; a total that reaches it has a partial of at least
its share (the cutoff over the number of lists) in some list, so those entries are sufficient. Phase three
resolves the totals of the vectors found, exactly. Queries go in blocks of a stated size, each against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fabula.llm.shared import stored

LISTS = 2
#: Queries whose vectors are broadcast at once.
QUERIES_AT_ONCE = 4096
SCALE = 256


def quantised(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, vec array<long>) of the rows that take part, each once: no null id, no null or non-finite component."""
    named = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(embedding), lambda v: v.cast("double")).alias("x"))
    broken = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return named.where("vec_id is not null and x is not null").where(~F.coalesce(broken, F.lit(True))).select("vec_id", F.transform("x", lambda v: F.floor(v * SCALE).cast("long")).alias("vec"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of lists as a matrix of doubles, short rows filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def heads(p: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each column of p the k greatest: column, id, value."""
    k = min(k, len(p))
    at = np.argpartition(-p, k - 1, axis=0)[:k]
    q = np.broadcast_to(np.arange(p.shape[1]), at.shape)
    return q.ravel(), ids[at].ravel(), np.take_along_axis(p, at, 0).ravel()


def top_k(rows: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", lists: int = LISTS, queries_at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `is_query` (a condition on vec_id) picks, its k best others.

    Components are floor(256 x); scores are exact while their absolute values stay below 2**53. Ties go to the
    smaller vec_id; a repeated row counts once, and rows of the query's own id never answer it. Vectors of unequal
    length are filled up with zeros. An empty table, or one without queries, gives an empty result.
    """
    spark = rows.sparkSession
    kept = quantised(rows, vec_id, embedding).dropDuplicates(["vec_id", "vec"])
    # Equal vectors are one class: its k + 1 smallest ids are all that an answer can need.
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = stored(kept.withColumn("place", place).where(F.col("place") <= k + 1), "vectors")
    classes = stored(few.groupBy("vec").agg(F.min("vec_id").alias("class_id"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "vector-classes")
    width = classes.agg(F.max(F.size("vec"))).first()[0] or 0
    step = max(1, -(-width // lists))
    cut = F.explode(F.array(*[F.struct(F.lit(i).alias("list"), F.slice("vec", i * step + 1, step).alias("part")) for i in range(lists)])).alias("x")
    parts = stored(classes.select("class_id", cut).select("class_id", "x.list", "x.part"), "vector-lists")
    # every query is needed, in copies of one vector too, so they come from the rows and not from the classes
    asked = kept.where(is_query).select(F.col("vec_id"), "vec")
    out: DataFrame | None = None
    batch: list = []

    def answer(block: list) -> DataFrame:
        ids = np.array([r.vec_id for r in block], np.int64)
        q = np.zeros((len(block), lists * step))
        for i, r in enumerate(block):
            q[i, : len(r.vec)] = r.vec
        sent = spark.sparkContext.broadcast(q)

        def each_list(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            which, own = b.column("list").to_numpy(), b.column("class_id").to_numpy()
            x = matrix(b.column("part"), step)
            for i in np.unique(which).tolist():
                yield i, own[which == i], x[which == i] @ sent.value[:, i * step : (i + 1) * step].T

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, own, p in each_list(b):
                    n, c, v = heads(p, own, k + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(np.full(len(n), i, np.int32)), pa.array(c), pa.array(v)], names=["q", "list", "class_id", "partial"])

        best = F.row_number().over(Window.partitionBy("q", "list").orderBy(F.desc("partial"), "class_id"))
        head = parts.mapInArrow(gather, "q int, list int, class_id long, partial double").withColumn("place", best).where(F.col("place") <= k + 1)

        def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, asked_by = matrix(b.column("vec"), lists * step), b.column("qs")
                n = np.diff(asked_by.offsets.to_numpy())
                qs = asked_by.flatten().to_numpy()
                own = np.repeat(np.arange(len(n)), n)
                for i in range(0, len(qs), 1 << 16):
                    at = slice(i, i + (1 << 16))
                    score = np.einsum("ij,ij->i", x[own[at]], sent.value[qs[at]])
                    yield pa.RecordBatch.from_arrays([pa.array(qs[at].astype(np.int32)), pa.array(b.column("class_id").to_numpy()[own[at]]), pa.array(score)], names=["q", "class_id", "total"])

        def resolved(found: DataFrame) -> DataFrame:
            grouped = found.groupBy("class_id").agg(F.collect_set("q").alias("qs"))
            return classes.select("class_id", "vec").join(grouped, "class_id").mapInArrow(totals, "q int, class_id long, total double")

        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("total"), "class_id"))
        known = resolved(head.select("q", "class_id")).withColumn("place", rank).where(F.col("place") == k + 1).select("q", "total").collect()
        least = np.full(len(block), -np.inf)  # with fewer classes than that, all entries are sufficient
        for r in known:
            least[r.q] = r.total
        share = spark.sparkContext.broadcast(least / lists)

        def sufficient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, own, p in each_list(b):
                    c, n = np.nonzero(p >= share.value)
                    yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(own[c])], names=["q", "class_id"])

        enough = parts.mapInArrow(sufficient, "q int, class_id long")
        found = resolved(enough)
        cutoff = spark.sparkContext.broadcast(least)

        def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q_at = b.column("q").to_numpy()
                kept_rows = b.filter(pa.array(b.column("total").to_numpy() >= cutoff.value[q_at]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[kept_rows.column("q").to_numpy()]), kept_rows.column("class_id"), kept_rows.column("total")], names=["query_id", "class_id", "total"])

        exact = found.mapInArrow(above, "query_id long, class_id long, total double")
        answers = exact.join(classes.select("class_id", "ids"), "class_id").select("query_id", F.explode("ids").alias("vec_id"), F.col("total").cast("long").alias("score")).where("vec_id <> query_id")
        last = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return answers.withColumn("rank", last).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    for r in asked.toLocalIterator():
        batch.append(r)
        if len(batch) == queries_at_once:
            out = answer(batch) if out is None else out.unionByName(answer(batch))
            batch = []
    if batch:
        out = answer(batch) if out is None else out.unionByName(answer(batch))
    return out if out is not None else spark.createDataFrame([], StructType.fromDDL("query_id long, rank int, vec_id long, score long"))
