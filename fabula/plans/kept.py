"""Registered queries on tables that are kept up to date: by streams, and by changes to partial sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabula import storage
from fabula.operators import dashboard, model_calls
from fabula.plans.queries import _chunks, query
from fabula.streaming.keyed import KeyedTable


@query("""select task_id, max(seq) seq, arg_max(status, seq) status, arg_max(novel_id, seq) filter (where novel_id is not null) novel_id, cast(sum(seq % 100) as bigint) tokens_in, cast(sum(seq % 10) as bigint) tokens_out from task_event group by 1""")
def task_table(v):
    """Tasks as a stream of their events leaves them, written in micro-batches."""
    root = storage.scratch(v.spark, "task-table")
    events = v.task_event().withColumns({"tokens_in": F.col("seq") % 100, "tokens_out": F.col("seq") % 10})
    events.repartitionByRange(4, "seq").write.parquet(f"{root}/log")
    table = KeyedTable(v.spark, f"{root}/table", ["task_id"], "seq", ["status", "novel_id"], ["tokens_in", "tokens_out"])
    table.follow(v.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/log"), f"{root}/checkpoint").awaitTermination()
    return table.read()


def _usage_deltas(v):
    """The usage in four deltas, each with rows of all days, and a fifth that takes back what is 0 modulo 10."""
    root = storage.scratch(v.spark, "usage-rollup")
    rollup = dashboard.UsageRollup(v.spark, root)
    usage = v.usage()
    for i in range(4):
        rollup.add(usage.where(F.col("event_id") % 4 == i), i)
    rollup.add(usage.where("event_id % 4 = 1"), 1)  # sent again
    rollup.table.compact()
    rollup.add(usage.where("event_id % 10 = 0"), 4, sign=-1)
    return rollup


@query("""select owner_id, coalesce(model, '') model, cast(sum(tokens_in) as bigint) tokens_in, cast(sum(tokens_out) as bigint) tokens_out, count(*) calls, cast(sum(cost) as double) cost from usage where event_id % 10 <> 0 group by all""")
def usage_rollup(v):
    """Sums by owner and model from a rollup of five deltas."""
    return _usage_deltas(v).totals("owner_id", "model").withColumn("model", F.coalesce("model", F.lit("")))


@query("""select cast(date_trunc('week', created_at) as varchar)[1:10] as week, task_type, cast(sum(tokens_in) as bigint) tokens_in, count(*) calls from usage where event_id % 10 <> 0 group by all""")
def usage_rollup_weeks(v):
    """Monday weeks from the same rollup's days."""
    weeks = _usage_deltas(v).totals(F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week"), F.col("task_type"))
    return weeks.select("week", "task_type", "tokens_in", "calls")


@query()
def summary_by_budget(v):
    """Documents summarised in rounds, each prompt within 400 characters; held against a plain version in the tests."""
    rounds = storage.Rounds(v.spark, storage.scratch(v.spark, "summaries"))
    return model_calls.reduce_by_budget(_chunks(v, 800, 0), "doc_id", "piece_no", "content", rounds.stored, budget=400)
