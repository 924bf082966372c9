"""Nearest vectors, exactly: blocks of vectors meet blocks of queries, and matrix products leave few pairs to be measured.

Few queries are broadcast. Many are dealt out, as the vectors are, and every part of the ones meets every part of the others in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions.vector import squared_l2
from fabula.operators import tables
from fabula.operators.vector_index import SLACK, nearest_rows

#: Queries that are broadcast at most. Vectors that are scored at once, and queries that they are scored for.
QUERIES, BLOCK, ASKED = 10_000, 4096, 256
#: Components of a packed block at most, and of the vectors that a task holds, about (40 MB).
PACKED, HELD = 1 << 19, 5_000_000
#: Components beyond that are too large for matrix products of their squares.
LARGE = 1e100


def sound(v: Column) -> Column:
    """Whether all components are numbers that matrix products are right for; null for a null vector."""
    return (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGE))


def pack(rows: DataFrame, id_col: str, vector: str, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(width, by, ids, vectors) of up to `n` neighbouring rows (id, array<double>) of one width, and alike in the whole numbers `by`."""

    listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.stack([b.column(vector).value_lengths().to_numpy(zero_copy_only=False), *[b.column(c).to_numpy() for c in by]], 1)
            found, which = np.unique(keys, axis=0, return_inverse=True)
            for i, key in enumerate(found.tolist()):
                at, most = np.flatnonzero(which.ravel() == i), max(1, min(n, PACKED // max(key[0], 1)))
                for j in range(0, len(at), most):
                    own = b.take(pa.array(at[j : j + most]))
                    yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int32()) for x in key], listed(own.column(id_col)), listed(own.column(vector).flatten())], names=["width", *by, "ids", "vectors"])

    return rows.select(id_col, vector, *by).mapInArrow(run, "width int, " + "".join(f"{c} int, " for c in by) + "ids array<long>, vectors array<double>")


def best(a: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, id, distance) the k nearest of each query, ties to the smaller id; nan is farthest."""
    order = np.lexsort((ids, far, a))
    a, ids, far = a[order], ids[order], far[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], ids[keep], far[keep]


def few_copies(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that can be among a query's k nearest: of equal vectors those of the k + 1 smallest ids, as one may be the query's own."""
    same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    same, own = same[order], ids[order]
    new = np.append(True, (same[1:] != same[:-1]) | (own[1:] != own[:-1]))
    place = np.cumsum(new) - np.cumsum(new)[np.searchsorted(same, same)]
    kept = np.sort(order[place <= k])
    return x[kept], ids[kept]


def nearest_sound(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, squared distance) of the k nearest of each query, block after block: what is farther than the k-th so far is not measured."""
    # q.x - |x|^2 / 2 falls as the distance grows; the sum of squares gives way for rounding
    y, z = np.column_stack([q, np.full(len(q), -1.0)]), (q**2).sum(1) * (1 - SLACK)
    got = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    limit = np.full(len(q), np.inf)
    room, mark = np.empty(len(q) * min(BLOCK, len(x))), np.empty(len(q) * min(BLOCK, len(x)), bool)

    def measured(a: np.ndarray, part: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In the components' order, as `functions.vector.squared_l2` adds them."""
        cuts = range(0, len(a), BLOCK)
        return np.concatenate([np.zeros(0), *[np.cumsum((part[b[i : i + BLOCK]] - q[a[i : i + BLOCK]]) ** 2, axis=1)[:, -1] for i in cuts]])

    for i in range(0, len(x), BLOCK):
        part, named = x[i : i + BLOCK], ids[i : i + BLOCK]
        within = len(q) * len(part)
        near = np.matmul(y, np.column_stack([part, (part**2).sum(1) * (1 - SLACK) / 2]).T, out=room[:within].reshape(len(q), -1))
        if np.isinf(limit).any() and len(part) > k:
            near[own[:, None] == named] = -np.inf
            at = np.argpartition(near, -k, axis=1)[:, -k:]
            a = np.repeat(np.arange(len(q)), k)
            far = np.where(np.isinf(near[a, at.ravel()]), np.inf, measured(a, part, at.ravel()))
            limit = np.minimum(limit, far.reshape(len(q), k).max(1))
        np.greater_equal(near, ((z - limit) / 2)[:, None], out=mark[:within].reshape(len(q), -1))
        a, b = np.divmod(np.flatnonzero(mark[:within]), len(part))
        other = own[a] != named[b]
        a, b = a[other], b[other]
        if len(a):
            got = best(*(np.concatenate(x) for x in zip(got, (a, named[b], measured(a, part, b)))), k)
            last = np.flatnonzero(np.bincount(got[0], minlength=len(q)) == k)
            limit[last] = np.minimum(limit[last], got[2][np.searchsorted(got[0], last, side="right") - 1])
    return got


def nearest_odd(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, no_x: np.ndarray, no_q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for vectors or queries that are not sound, one query after the other; those with a null (`no_x`, `no_q`) are at -inf, before all others."""
    got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    with np.errstate(all="ignore"):
        for a in range(len(q)):
            for i in range(0, len(x), BLOCK):
                far = np.cumsum((x[i : i + BLOCK] - q[a]) ** 2, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x[i : i + BLOCK]))
                far[no_x[i : i + BLOCK] | no_q[a]] = -np.inf
                at = np.flatnonzero(ids[i : i + BLOCK] != own[a])
                got.append(best(np.full(len(at), a), ids[i : i + BLOCK][at], far[at], k))
    return best(*map(np.concatenate, zip(*got)), k)


def scored_apart(rows: DataFrame, asked: DataFrame, k: int, queries: int) -> DataFrame:
    """(query_id, vec_id, distance) of each query's k nearest in each part of the vectors.

    Vectors are dealt by a hash of their ids to parts of about HELD components, and so are the queries. A task holds a part of the
    vectors while the blocks of a part of the queries pass; each vector is sent to all parts of the queries, each query to all parts of the vectors.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = lambda df, v: -(-(df.agg(F.sum(F.size(v))).first()[0] or 1) // HELD)
    down = parts(rows, "v")
    # no more parts of queries than queries, however many cores there are
    across = min(queries, max(parts(asked, "q"), -(-2 * cores // down)))
    part = lambda df, i, v, n: df.select(i, v, sound(F.col(v)).cast("int").alias("sound"), F.pmod(F.xxhash64(i), F.lit(n)).cast("int").alias("part"))
    by, each = ("sound", "part"), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    staying = pack(part(tables.spread(rows, "vec_id"), "vec_id", "v", down), "vec_id", "v", BLOCK, by).withColumn("other", each(across)).withColumn("cell", F.col("part") * across + F.col("other"))
    passing = pack(part(tables.spread(asked, "query_id"), "query_id", "q", across), "query_id", "q", 4 * ASKED, by).withColumn("other", each(down)).withColumn("cell", F.col("other") * across + F.col("part"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for b in batches:
            for i in range(b.num_rows):
                at, passes, *kind = (b.column(c)[i].as_py() for c in ("cell", "passes", "width", "sound"))
                values, ids = b.column("vectors").slice(i, 1).flatten(), b.column("ids").slice(i, 1).flatten().to_numpy()
                x, null = (v.reshape(len(ids), kind[0]) for v in (values.to_numpy(zero_copy_only=False), values.is_null().to_numpy(zero_copy_only=False)))
                block = x, ids, null.any(1)
                if at != cell:
                    cell, held = at, {}
                if not passes:
                    held.setdefault(tuple(kind), []).append(tuple(map(np.array, block)))
                    continue
                for s in (0, 1):
                    key = kind[0], s
                    if isinstance(held.get(key), list):
                        whole = tuple(map(np.concatenate, zip(*held.pop(key))))
                        held[key] = (*few_copies(*whole[:2], k), whole[2][:0]) if s else whole
                    if key in held:
                        stay, names, no = held[key]
                        a, found, far = nearest_sound(stay, names, *block[:2], k) if s and kind[1] else nearest_odd(stay, names, *block[:2], k, no if len(no) else np.zeros(len(stay), bool), block[2])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(found), pa.array(far, mask=np.isneginf(far))], names=["query_id", "vec_id", "distance"])

    columns = ["cell", "passes", "width", "sound", "ids", "vectors"]
    both = staying.withColumn("passes", F.lit(False)).select(columns).unionAll(passing.withColumn("passes", F.lit(True)).select(columns))
    return both.repartition(down * across, "cell").sortWithinPartitions("cell", "passes").mapInArrow(meet, "query_id long, vec_id long, distance double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest by squared L2 of each query, itself left out; ties to the smaller id.

    Ids are whole numbers. A block of vectors sends each query's k nearest of its own; of more than QUERIES queries a part of the
    vectors does (`scored_apart`). Distances from or to a vector with a null or not finite component are computed one by one.
    """
    columns = lambda df, i, v: df.select(F.col(id_col).cast("long").alias(i), F.col(vector).cast("array<double>").alias(v)).where(F.col(i).isNotNull() & F.col(v).isNotNull())
    asked, rows = columns(queries, "query_id", "q"), columns(vectors, "vec_id", "v")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    if (many := asked.count()) > QUERIES:
        return scored_apart(rows, asked, k, many).withColumn("rank", rank).where(F.col("rank") <= k)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                part = b.slice(i, 1)
                ids, own = part.column("ids").flatten().to_numpy(), part.column("asked").flatten().to_numpy()
                x, q = (part.column(c).flatten().to_numpy().reshape(len(n), -1) for c, n in (("vectors", ids), ("q", own)))
                for j in range(0, len(own), ASKED):
                    a, found, exact = nearest_rows(x, ids, q[j : j + ASKED], own[j : j + ASKED], k)
                    yield pa.RecordBatch.from_arrays([pa.array(own[j + a]), pa.array(found), pa.array(exact)], names=["query_id", "vec_id", "distance"])

    packed = pack(tables.spread(rows.where(sound(F.col("v"))), "vec_id"), "vec_id", "v", BLOCK)
    plain, met = asked.where(sound(F.col("q"))), (F.col("vec_id") != F.col("query_id")) & (F.size("v") == F.size("q"))
    sent = pack(plain, "query_id", "q", 4 * ASKED).select("width", F.col("ids").alias("asked"), F.col("vectors").alias("q"))
    scored = [packed.join(F.broadcast(sent), "width").select("ids", "vectors", "asked", "q").mapInArrow(score, "query_id long, vec_id long, distance double")]
    # no pair is in both: of one, either the vector is not sound, or it is and the query is not
    for v, q in ((rows.where(~sound(F.col("v"))), asked), (rows.where(sound(F.col("v"))), asked.where(~sound(F.col("q"))))):
        scored.append(v.join(F.broadcast(q), met).select("query_id", "vec_id", squared_l2(F.col("v"), F.col("q")).alias("distance")))
    return reduce(DataFrame.unionAll, scored).withColumn("rank", rank).where(F.col("rank") <= k)
