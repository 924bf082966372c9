"""What of a conversation goes to the model: the last turns whole, the others compressed when it grows long."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions.text import token_estimate


def window_plan(turns: DataFrame, keep_recent: int, context_window: int) -> DataFrame:
    """turns with est_tokens, total_tokens and part: `keep`, or `compress` for old turns of a conversation beyond the window."""
    by = Window.partitionBy("conv_id")
    est = turns.withColumn("est_tokens", token_estimate(F.col("text")))
    back = F.row_number().over(by.orderBy(F.desc("turn")))
    full = est.withColumns({"total_tokens": F.sum("est_tokens").over(by), "back": back})
    return full.withColumn("part", F.when((F.col("total_tokens") > context_window) & (F.col("back") > keep_recent), "compress").otherwise("keep")).drop("back")


def assemble(plan: DataFrame) -> DataFrame:
    """(conv_id, head, body): old turns to be compressed and the turns that are kept, in order."""
    rows = plan.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "part"))).alias("turns"))
    joined = lambda part: F.array_join(F.transform(F.filter("turns", lambda t: t["part"] == part), lambda t: F.concat_ws(": ", t["role"], t["text"])), "\n")
    return rows.select("conv_id", joined("compress").alias("head"), joined("keep").alias("body"))
