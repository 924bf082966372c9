"""An index of vectors in cells, for nearest neighbours that stay exact.

Every vector is in the cell of its nearest centre. A cell's radius is the distance of its farthest vector, so by the
triangle inequality none of its vectors is nearer to a query than the query's distance to the centre less that radius.
A search reads a query's most promising cells first, until they hold k vectors; the k-th distance then tells which
other cells can matter. The index is a folder: `blocks/cell=c` (ids, vectors) in blocks of bounded size, and `cells`
(cell, centre, radius, n), which is small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Cells of an index at most, vectors that centres are fitted on for each cell, vectors of a block and queries of one, about.
MOST_CELLS, SAMPLE, BLOCK, ASKED = 4096, 32, 4096, 1024
#: Pairs of a query and a cell that a task holds at once, about.
PAIRS = 32_768
#: By how much a bound gives way for rounding, as a share of what it is made of.
SLACK = 1e-9


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def centres_of(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k-means on a sample whose first rows are the first centres."""
    c = np.unique(sample[:k], axis=0)
    for _ in range(rounds):
        parts = (sample[i : i + ASKED] for i in range(0, len(sample), ASKED))
        own = np.concatenate([((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1) for x in parts])
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def sampled(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About `most` of `n` rows (id, ...) and no more, those of the least hashes of their ids.

    Hashes too large for the sample are left out before any row is sent, and one task, not the driver, takes what is left.
    """
    few = F.pmod(F.xxhash64("id"), F.lit(1 << 32)) < int(min(1.0, 1.25 * most / max(n, 1)) * (1 << 32))
    return rows.where(few).orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 32)), "id").limit(most).repartition(1)


def build(vectors: DataFrame, root: str, id_col: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> None:
    """Writes an index of the vectors of the most frequent length. Null vectors, null ids and those with a null component are left out.

    Centres are fitted on a sample of SAMPLE vectors a cell, by a hash of their ids; every vector is in the index.
    """
    spark = vectors.sparkSession
    sound = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null and not exists(v, x -> x is null)")
    top = sound.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if top is None:
        raise ValueError("there is no vector to index")
    rows = sound.where(F.size("v") == top.width)
    k = cells or max(1, min(MOST_CELLS, int(np.sqrt(top["count"]))))
    sample = sampled(rows, top["count"], k * SAMPLE).select("v").toArrow().column("v").combine_chunks()
    centres = centres_of(matrix(sample), k)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"))
            cell, far = np.zeros(len(x), np.int32), np.zeros(len(x))
            for i in range(0, len(x), BLOCK):
                part = x[i : i + BLOCK]
                cell[i : i + BLOCK] = ((centres**2).sum(1) - 2 * part @ centres.T).argmin(1)
                far[i : i + BLOCK] = np.sqrt(((part - centres[cell[i : i + BLOCK]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell), pa.array(far)], names=["id", "v", "cell", "far"])

    dealt = rows.mapInArrow(deal, "id long, v array<double>, cell int, far double")
    # a large cell's vectors go to several blocks, so that no cell is gathered in one
    counts = {r.cell: r["count"] for r in dealt.groupBy("cell").count().collect()}  # MOST_CELLS rows at most
    blocks = F.array(*[F.lit(-(-counts.get(i, 1) // BLOCK)) for i in range(len(centres))])
    packed = dealt.groupBy("cell", F.pmod(F.xxhash64("id"), F.get(blocks, F.col("cell"))).alias("block")).agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("vectors"), F.max("far").alias("far"))
    packed.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{root}/blocks")
    sizes = spark.read.parquet(f"{root}/blocks").groupBy("cell").agg(F.max("far").alias("radius"), F.sum(F.size("ids")).alias("n"))
    named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    sizes.join(F.broadcast(named), "cell").coalesce(1).write.mode("overwrite").parquet(f"{root}/cells")


def nearest_rows(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, squared distance) of each query's k nearest, itself left out; a matrix product finds those that are then measured exactly.

    Squares are added in the components' order, as `functions.vector.squared_l2` does.
    """
    sums = (x**2).sum(1)[None] + (q**2).sum(1)[:, None]
    near = sums - 2 * q @ x.T
    near[own[:, None] == ids[None]] = np.inf
    kth = np.partition(near, min(k, near.shape[1]) - 1, axis=1)[:, min(k, near.shape[1]) - 1]
    a, b = np.nonzero((near <= kth[:, None] + SLACK * sums) & np.isfinite(near))
    exact = np.empty(len(a))
    for i in range(0, len(a), BLOCK):
        exact[i : i + BLOCK] = np.cumsum((x[b[i : i + BLOCK]] - q[a[i : i + BLOCK]]) ** 2, axis=1)[:, -1]
    order = np.lexsort((ids[b], exact, a))
    a, b, exact = a[order], b[order], exact[order]
    place = np.arange(len(a)) - np.repeat(np.append(0, np.flatnonzero(np.diff(a)) + 1), np.diff(np.append(np.append(0, np.flatnonzero(np.diff(a)) + 1), len(a)))) if len(a) else a
    return a[place < k], ids[b[place < k]], exact[place < k]


def search(spark: SparkSession, root: str, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, distance, rank, cells) of the k nearest by squared L2 of each query, itself left out, ties to the smaller id.

    `cells` is how many cells of the index the query's answer took. Queries of another length than the index's find nothing.
    """
    known = spark.read.parquet(f"{root}/cells").orderBy("cell").collect()  # MOST_CELLS rows at most
    cell, radius, n = np.array([r.cell for r in known]), np.array([r.radius for r in known]), np.array([r.n for r in known])
    centre = np.array([r.centre for r in known])
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("q")).where(F.col("query_id").isNotNull() & (F.size("q") == centre.shape[1]) & ~F.exists("q", lambda x: x.isNull()))

    def bounds(q: np.ndarray) -> np.ndarray:
        """Of each query and cell, how near a vector can be."""
        sums = (q**2).sum(1)[:, None] + (centre**2).sum(1)
        far = np.sqrt(np.maximum(sums - 2 * q @ centre.T - SLACK * sums, 0))
        return np.maximum(far - radius * (1 + SLACK), 0)

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """So few queries at once that they can have PAIRS pairs with cells, about."""
        n = max(1, PAIRS // len(cell))
        return (b.slice(i, n) for b in batches for i in range(0, b.num_rows, n))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The most promising cells, until they hold k others."""
        for b in few(batches):
            q = matrix(b.column("q"))
            order = np.argsort(bounds(q), axis=1, kind="stable")
            enough = np.minimum((np.cumsum(n[order], axis=1) < k + 1).sum(1) + 1, len(cell))
            row = np.repeat(np.arange(len(q)), enough)
            at = order[row, np.arange(len(row)) - np.repeat(np.cumsum(enough) - enough, enough)]
            yield pa.RecordBatch.from_arrays([pa.array(cell[at].astype(np.int32)), b.column("query_id").take(pa.array(row)), b.column("q").take(pa.array(row))], names=["cell", "query_id", "q"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All cells that can hold a vector as near as the k-th that is known."""
        for b in few(batches):
            q = matrix(b.column("q"))
            kth = b.column("kth").to_numpy(zero_copy_only=False)
            row, at = np.nonzero(bounds(q) <= (np.sqrt(kth) * (1 + SLACK))[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(cell[at].astype(np.int32)), b.column("query_id").take(pa.array(row)), b.column("q").take(pa.array(row))], names=["cell", "query_id", "q"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, rows = b.column("ids").slice(i, 1).flatten().to_numpy(), b.column("asked").slice(i, 1).flatten()
                x = b.column("vectors").slice(i, 1).flatten().to_numpy().reshape(len(ids), -1)
                own = rows.field("query_id").to_numpy()
                a, found, exact = nearest_rows(x, ids, matrix(rows.field("q")), own, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(found), pa.array(exact)], names=["query_id", "vec_id", "distance"])

    def answers(pairs: DataFrame) -> DataFrame:
        many = max(1, -(-asked.count() // ASKED))
        packed = pairs.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(many)).alias("part")).agg(F.collect_list(F.struct("query_id", "q")).alias("asked"))
        read = [r.cell for r in pairs.select("cell").distinct().collect()]  # MOST_CELLS at most: only their folders are listed
        blocks = spark.read.parquet(f"{root}/blocks").where(F.col("cell").isin(read)).select("cell", "ids", "vectors")
        best = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
        # Spark sizes the pairs as the queries alone, so it would broadcast them all through the driver
        return blocks.join(packed.select("cell", "asked").hint("merge"), "cell").mapInArrow(score, "query_id long, vec_id long, distance double").withColumn("rank", best).where(F.col("rank") <= k)

    pair = "cell int, query_id long, q array<double>"
    near = answers(asked.mapInArrow(first, pair)).groupBy("query_id").agg(F.max("distance").alias("kth"), F.count(F.lit(1)).alias("n"))
    # of fewer than k others in all cells, the farthest is no bound
    limits = asked.join(near, "query_id", "left").select("query_id", "q", F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(float("inf"))).alias("kth"))
    pairs = limits.repartition(2 * spark.sparkContext.defaultParallelism, "query_id").mapInArrow(within, pair)
    cells = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("cells"))
    return answers(pairs).join(cells, "query_id").select("query_id", "vec_id", "distance", "rank", "cells")
