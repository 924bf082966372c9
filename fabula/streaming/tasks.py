"""Streams over an append-only log of task events (task_id, seq, status, owner_id, novel_id, ts)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TERMINAL = ("success", "failed", "cancelled")


def timed(df: DataFrame, lateness: str) -> DataFrame:
    """`df` with a watermark on ts; a time without a zone is the session's."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def progress(events: DataFrame) -> DataFrame:
    """Of each task and field the last value that was set (update or complete mode)."""
    return events.groupBy("task_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"), F.max_by("novel_id", F.when(F.col("novel_id").isNotNull(), F.col("seq"))).alias("novel_id"))


def terminal_once(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The first row of each task and terminal status; state goes with the watermark."""
    return timed(events.where(F.col("status").isin(*TERMINAL)), lateness).dropDuplicatesWithinWatermark(["task_id", "status"])


def usage_once(usage: DataFrame, lateness: str = "1 day") -> DataFrame:
    """One usage row for each task, however often it is sent."""
    return timed(usage, lateness).dropDuplicatesWithinWatermark(["task_id"])


def trend(usage: DataFrame, unit: str = "day", lateness: str = "1 day") -> DataFrame:
    """Tokens by day, or by week from Monday."""
    w = F.window("ts", "1 day") if unit == "day" else F.window("ts", "7 days", "7 days", "4 days")
    return timed(usage, lateness).groupBy(w.alias("w")).agg(F.sum("tokens_in").alias("tokens_in")).select(F.col("w.start").alias("bucket"), "tokens_in")


def until_terminal(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(task_id, seq, status) of a task's events up to its first terminal one; what comes after that is dropped.

    Events of a task must not come before earlier ones of it by more than a batch. That a task has ended is state until
    the watermark passes its end.
    """

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ended = state.get[0] if state.exists else None
        own = pd.concat(list(frames)).sort_values("seq")
        if ended is None:
            ends = own.loc[own["status"].isin(TERMINAL), "seq"]
            ended = int(ends.min()) if len(ends) else None
            yield (own if ended is None else own[own["seq"] <= ended])[["task_id", "seq", "status"]]
        if ended is not None:
            state.update((ended,))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(own["ts"].max().timestamp() * 1000)) + 1)

    return timed(events, lateness).groupBy("task_id").applyInPandasWithState(follow, "task_id long, seq long, status string", "ended long", "append", GroupStateTimeout.EventTimeTimeout)


def retries(latest: DataFrame, asked: DataFrame) -> DataFrame:
    """New event rows for the tasks that are asked to run again and whose latest status is `failed`; others are passed over."""
    return latest.where("status = 'failed'").join(asked.select("task_id"), "task_id", "left_semi").select("task_id", (F.col("seq") + 1).alias("seq"), F.lit("running").alias("status"), "ts")


class Gather(StatefulProcessor):
    """Pieces of open conversations as a list: a batch adds what it brings, and what is there is not written again."""

    def __init__(self, wait: int | None):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "seq long, piece string")

    def _forget(self) -> None:
        self.pieces.clear()
        if self.wait:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = False
        for f in rows:
            self.pieces.appendList(list(zip(f["seq"].tolist(), f["piece"].tolist(), strict=True)))
            done = done or bool(f["done"].any())
        if done:
            kept = dict(tuple(p) for p in self.pieces.get())  # of a number that comes twice the later piece counts
            self._forget()
            yield pd.DataFrame({"conv_id": [key[0]], "text": ["".join(kept[k] for k in sorted(kept))]})
        elif self.wait:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget()
        return iter(())

    def close(self) -> None:
        pass


def replies(pieces: DataFrame, idle: str | None = None) -> DataFrame:
    """(conv_id, text) when a conversation's `done` piece comes: its pieces (conv_id, seq, piece, done) in order.

    Pieces of the conversations that are open are a list in RocksDB, to which a batch only adds; a conversation that is
    done leaves none. In a query that runs on and on, `idle` (such as "30 minutes") ends conversations to which nothing is
    added, without a result; a query that is to end by itself (availableNow) must do without, for Spark goes on as long
    as a timer may come. Sets the session's state store to RocksDB, which lists need.
    """
    pieces.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    return pieces.groupBy("conv_id").transformWithStateInPandas(Gather(wait), "conv_id long, text string", "Append", "ProcessingTime" if wait else "None")
