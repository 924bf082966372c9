"""Connected components by alternating star operations, as DataFrame joins over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm.shared import drop, passing, stored, stored_with_sum, tasks

#: Links of a task, about: of few links a round is a few tasks, and not one for each shuffle partition.
LINKS = 20_000


def connected(links: DataFrame) -> DataFrame:
    """(id, component), stored, of every id in `links` (a, b): component is the smallest id in reach.

    In a large star every neighbour above an id moves to the id's least neighbour; in a small star those below do.
    The ids' minima are stored before they are joined back, so that Spark can split a hub's rows. It ends when a
    round changes no link, and not before: each round lowers what links point to, so an end there is.
    """
    def dealt(df: DataFrame, n: int) -> DataFrame:
        return df.coalesce(max(1, min(tasks(df.sparkSession), n // LINKS)))

    with passing() as kept:
        e, sign = stored_with_sum(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
        while True:
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            n = sign[0]
            least = stored(dealt(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), n), "least")
            large = stored(dealt(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), n), "links")
            lower = stored(dealt(large.groupBy("u").agg(F.min("v").alias("m")), n), "least")
            small = large.join(lower, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v")
            after, now = stored_with_sum(dealt(small.distinct(), n), "links")
            drop(e, least, large, lower)
            e = after
            if now == sign:
                break
            sign = now
        roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
        out = stored(e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), "components")
        kept.append(out)
    return out
