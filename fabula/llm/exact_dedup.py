"""Exact dedup with a heavy-hitter split, in DataFrame functions alone.

Spark's `approx_top_k` sketch keeps counters as Misra and Gries do, mergeable: a value's estimate errs by at most 3.5
rows in TRACKED of all. Digests that it names are counted exactly; those that really hold more than one row in SHARE
are the heavy ones, 8,191 at most however large the table is. Their winners are broadcast, and rows with a heavy digest
find theirs where they are read, without moving. All other rows go to their digest's partition, where no digest has
more than that share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.llm.shared import passing, stored, texts

#: A digest is heavy when more than one row in SHARE holds it.
SHARE = 8192
#: Counters of a sketch. Its error, 3.5 / TRACKED of the rows, is below half the share, so that no heavy digest is missed
#: among the CANDIDATES with the largest estimates: fewer than that can have an estimate of 1 / SHARE of the rows.
TRACKED = 65536
CANDIDATES = 16384
#: Sketches are merged in so many groups of tasks first, then once more.
MERGES = 64

SPACE = r"[\x20\x09-\x0D]+"


def without_space(text: Column) -> Column:
    """A text after every space, tab and line end is deleted; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def candidates(rows: DataFrame, tracked: int = TRACKED, most: int = CANDIDATES) -> DataFrame:
    """(digest) the values of the long column `digest` with the largest estimates, `most` at most, each once."""
    parts = rows.select("digest", (F.spark_partition_id() % MERGES).alias("part")).groupBy("part").agg(F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("sketch"))
    # grouped by one constant: a task without rows then has no sketch, as an empty one cannot be merged
    merged = parts.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {tracked}), {most})").alias("top"))
    return merged.select(F.explode("top").alias("top")).select("top.item").withColumnRenamed("item", "digest")


def _winner() -> Column:
    """The least of this is the row that stays: most code points, then smallest doc_id, a null one last, then first read."""
    return F.struct((-F.col("n_points")).alias("less"), F.isnull("doc_id").alias("no_id"), "doc_id", "row_no")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = SHARE, tracked: int = TRACKED, most: int = CANDIDATES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of `docs`.

    Texts are equal when their SHA-256 after deleting white space is. Null text is empty, and all empty texts are equal.
    A null doc_id stays null and stays only where no row of its group has both its length and an id. Of repeated rows,
    one is kept at most. An empty table gives an empty result. Other columns are never read.
    """
    own = texts(docs, doc_id, text).select("doc_id", F.length("text").alias("n_points"), F.unhex(F.sha2(without_space(F.col("text")), 256)).alias("sha"), F.monotonically_increasing_id().alias("row_no"))
    with passing() as kept:
        rows = stored(own, "digests")
        kept.append(rows)
        keyed = rows.withColumn("digest", F.xxhash64("sha"))
        named = keyed.join(F.broadcast(candidates(keyed, tracked, most)), "digest", "left_semi")
        exact = named.groupBy("sha").agg(F.min(_winner()).alias("w"), F.count(F.lit(1)).alias("n"))
        heavy = stored(exact.where(F.col("n") * share > rows.count()).select("sha", F.col("w.doc_id").alias("keep_id"), F.col("w.row_no").alias("keep_row"), F.col("n").alias("group_size")), "winners")
        kept.append(heavy)
    # fewer than `share` rows of 60 bytes, whatever the table's size
    met = rows.join(F.broadcast(heavy), "sha").select("doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), "sha")
    same = Window.partitionBy("sha").orderBy(_winner()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = rows.join(F.broadcast(heavy.select("sha")), "sha", "left_anti").withColumns({"w": F.first(F.struct("doc_id", "row_no")).over(same), "group_size": F.count(F.lit(1)).over(same)})
    rest = rest.select("doc_id", F.col("w.doc_id").alias("keep_id"), "group_size", (F.col("row_no") == F.col("w.row_no")).alias("kept"), "sha")
    return met.unionByName(rest).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Rows that repeat both id and text of a row that stays stay too."""
    found = groups(docs, doc_id, text).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_id")) & (F.sha2(without_space(F.col(text)), 256) == F.col("_sha"))
    return docs.join(found, same, "left_semi")
