"""Figures over usage and task logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.streaming.keyed import KeyedTable


def cost() -> Column:
    """The sum of costs: of decimals, so that the order of rows does not matter."""
    return F.sum("cost").cast("double").alias("cost")


def counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of each table: one row each, so nothing is crossed."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def trend(usage: DataFrame, at: str, unit: str, buckets: int, *sums: str) -> DataFrame:
    """Sums by day or Monday week up to the latest row's, days without rows as zero, in ascending order."""
    last = F.date_trunc(unit, F.max(at))
    step = F.expr(f"interval 1 {unit}")
    calendar = usage.agg(last.alias("last")).select(F.explode(F.sequence(F.col("last") - step * (buckets - 1), F.col("last"), step)).alias("bucket"))
    totals = usage.groupBy(F.date_trunc(unit, at).alias("bucket")).agg(*[F.sum(c).alias(c) for c in sums])
    return calendar.join(totals, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums])


def by_group(usage: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    return usage.groupBy(*keys).agg(*aggs)


@dataclass
class UsageRollup:
    """Usage summed by day, owner, configuration, kind and model, kept up to date by deltas.

    A delta is a batch of usage rows, new ones, late ones, or rows that take others back (`sign` -1); it is added once,
    however often it is sent. All figures that need sums by those columns, or by weeks, come from the rollup and read no
    usage row. Costs are kept in millionths, as whole numbers.
    """

    spark: SparkSession
    root: str

    KEYS = ("day", "owner_id", "config_id", "task_type", "model")

    @property
    def table(self) -> KeyedTable:
        return KeyedTable(self.spark, self.root, list(self.KEYS), "created_at", [], ["tokens_in", "tokens_out", "calls", "cost_millionths"])

    def add(self, usage: DataFrame, batch: int, sign: int = 1) -> None:
        rows = usage.withColumns({"day": F.to_date("created_at"), "calls": F.lit(sign), "cost_millionths": F.round(F.col("cost") * 1_000_000).cast("long") * sign, "tokens_in": F.col("tokens_in") * sign, "tokens_out": F.col("tokens_out") * sign})
        self.table.write(rows, batch)

    def totals(self, *keys: str | Column) -> DataFrame:
        """(keys, tokens_in, tokens_out, calls, cost); groups of which all rows were taken back are left out."""
        rows = self.table.read()
        if rows is None:
            raise ValueError("there is no batch yet")
        sums = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "calls", "cost_millionths")])
        return sums.where("calls <> 0").withColumn("cost", (F.col("cost_millionths") / 1_000_000).cast("double")).drop("cost_millionths")


def estimate(words: Column, rate: int, forced_long: Column | None = None, long_minutes: int = 10) -> tuple[Column, Column]:
    """Minutes at `rate` words a minute, at least one, and whether that is long.

    Without words there is no estimate, but for a task that is long by its kind: `long_minutes`.
    """
    forced = F.lit(False) if forced_long is None else forced_long
    some = F.coalesce(words, F.lit(0)) > 0
    minutes = F.when(some, F.greatest(F.lit(1), F.ceil(words / F.lit(rate))).cast("long")).when(forced, F.lit(long_minutes).cast("long"))
    return minutes, F.when(some, (minutes > long_minutes) | forced).otherwise(forced)


def completed_at(now: Column, minutes: Column) -> Column:
    """When a task of so many minutes ends; null without an estimate."""
    return now + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))
