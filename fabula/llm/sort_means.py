"""Clusters by sort-means: centroids sorted by distance from each other tell when a scan may stop.

A vector's distance to its previous centroid bounds how far the nearest one can be from that centroid: twice as far, by
the triangle inequality. So the others are scanned in the order of their distance from it, up to strictly beyond twice.
Each round is a pass over the vectors, which are written with their new assignments, and sums in Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm.shared import drop, passing, stored
from fabula.llm.vectors import exact, matrix, whole

ROWS = "vec_id long, vec array<long>, cluster int, distance long"


def sorted_others(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each centroid, all centroids by squared distance from it, itself first, and those distances."""
    c = centroids.astype(exact(centroids, centroids))
    apart = ((c[:, None] - c[None]) ** 2).sum(-1)
    np.fill_diagonal(apart, -1)  # before others at the same place
    order = np.argsort(apart, axis=1, kind="stable")
    return order, np.maximum(np.take_along_axis(apart, order, 1), 0)


def assign(x: np.ndarray, previous: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (the smaller number of two as near), its squared distance, and how many distances were computed."""
    kind = exact(x, centroids)
    x, c = x.astype(kind), centroids.astype(kind)
    order, apart = sorted_others(centroids)
    near, least = previous.copy(), ((x - c[previous]) ** 2).sum(1)
    computed = len(x)
    for p in np.unique(previous).tolist():
        rows = np.flatnonzero(previous == p)
        reach = 4 * least[rows]
        by = np.argsort(-reach, kind="stable")
        rows, reach = rows[by], reach[by]
        for j, d in zip(order[p, 1:].tolist(), apart[p, 1:].tolist()):
            n = int((reach >= d).sum())  # the rows that go on are the first ones
            if not n:
                break
            at = rows[:n]
            far = ((x[at] - c[j]) ** 2).sum(1)
            closer = (far < least[at]) | ((far == least[at]) & (j < near[at]))
            near[at[closer]], least[at[closer]] = j, far[closer]
            computed += n
    return near, least.astype(np.int64), computed


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clusters(rows: DataFrame, k: int = 16, width: int = 64, rounds: int = 3, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector that is kept.

    Kept are vectors of exactly `width` components, none null or non-finite; components are floor(scale * x). They start
    from the k vectors with the smallest SHA-256 of `1:<vec_id>`, equal ids by their components, null ids last: with
    fewer vectors there are fewer centroids. Repeated rows are vectors of their own, and a null id stays null. Distances
    are exact; one that a long cannot hold is an error. An empty table gives an empty result. The centroids, k times
    `width` numbers, are what passes through the driver.
    """
    spark = rows.sparkSession
    with passing() as kept:
        now = stored(whole(rows, scale, vec_id, embedding, width).withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}), "vectors")
        first = now.select("vec", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h")).orderBy(F.asc_nulls_last("h"), "vec").limit(k).collect()
        centroids = np.array([r.vec for r in first], np.int64).reshape(len(first), width)

        def assigned(df: DataFrame, centroids: np.ndarray) -> DataFrame:
            def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    near, far, _ = assign(matrix(b.column("vec"), width), b.column("cluster").to_numpy().astype(np.int64), centroids)
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vec"), pa.array(near.astype(np.int32)), pa.array(far)], names=["vec_id", "vec", "cluster", "distance"])

            return df.mapInArrow(each, ROWS)

        for _ in range(rounds if len(first) else 0):
            before, now = now, stored(assigned(now, centroids), "assigned")
            drop(before)
            sums = now.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("vec")[i]).alias(f"s{i}") for i in range(width)])
            means = sums.select("cluster", F.array(*[F.expr(f"(s{i} - pmod(s{i}, n)) div n") for i in range(width)]).alias("mean")).collect()
            centroids = centroids.copy()  # what tasks of the round before have is theirs
            for r in means:
                centroids[r.cluster] = r.mean
        last = stored(assigned(now, centroids), "assigned")
        kept.append(last)
        inertia = {r.cluster: r.own for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}
    # a row for each centroid, k at most
    known = [(i, int(own), int(sum(inertia.values())), digest(centroids[i])) for i, own in inertia.items()]
    known = F.broadcast(spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return last.join(known, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
