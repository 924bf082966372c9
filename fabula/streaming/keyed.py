"""A table that a stream keeps up to date: the last values and the sums of each key.

A micro-batch is reduced to a row for each of its keys and written under its number; then its number goes to the ledger,
which is what makes it count. A batch that comes again, as one does after a crash between a write and the stream's own
commit, is in the ledger and changes nothing; one whose writing was interrupted is written anew in the same place.
Readers merge the batches of the ledger; `compact` puts them together, so that they stay few.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fabula import storage


@dataclass
class KeyedTable:
    """`fields` keep, each for itself, the value set last in `order`, nulls apart; `sums` add up over all rows that ever came.

    `root` is a folder that all executors share. Values that are set at the same place in `order` are taken by their own order.
    """

    spark: SparkSession
    root: str
    keys: list[str]
    order: str
    fields: list[str]
    sums: list[str]

    def _reduced(self, rows: DataFrame) -> DataFrame:
        """Rows to one for each key. A field comes with the place at which it was set."""
        last = [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(self.order).alias("at"), F.col(c).alias("value")))).alias(c) for c in self.fields]
        return rows.groupBy(*self.keys).agg(F.max(self.order).alias(self.order), *last, *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in self.sums])

    def _merged(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy(*self.keys).agg(F.max(self.order).alias(self.order), *[F.max(c).alias(c) for c in self.fields], *[F.sum(c).cast("long").alias(c) for c in self.sums])

    def _done(self, ledger: str) -> list[int]:
        return sorted(int(n) for n in storage.names(self.spark, f"{self.root}/{ledger}"))

    def _parts(self) -> DataFrame | None:
        bases = self._done("bases")
        base = bases[-1] if bases else -1
        paths = [f"{self.root}/base/{base}"] if bases else []
        paths += [f"{self.root}/batch/{n}" for n in self._done("ledger") if n > base]
        return self.spark.read.parquet(*paths) if paths else None

    def write(self, rows: DataFrame, batch: int) -> None:
        """Takes a micro-batch: what `foreachBatch` calls."""
        bases = self._done("bases")
        if batch in self._done("ledger") or bases and batch <= bases[-1]:
            return
        self._reduced(rows).write.mode("overwrite").parquet(f"{self.root}/batch/{batch}")
        storage.mark(self.spark, f"{self.root}/ledger/{batch}")

    def follow(self, rows: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts a stream of `rows` into the table; by default it ends when it has taken all there is."""
        return rows.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def read(self) -> DataFrame | None:
        """The table as the ledger has it; None before the first batch."""
        parts = self._parts()
        if parts is None:
            return None
        return self._merged(parts).select(*self.keys, self.order, *[F.col(c)["value"].alias(c) for c in self.fields], *self.sums)

    def compact(self) -> None:
        """Puts the batches so far together. Readers that have begun must have ended before the next one, which removes what this one replaces."""
        ledger, bases = self._done("ledger"), self._done("bases")
        if not ledger or bases and ledger[-1] <= bases[-1]:
            return
        self._merged(self._parts()).write.mode("overwrite").parquet(f"{self.root}/base/{ledger[-1]}")
        storage.mark(self.spark, f"{self.root}/bases/{ledger[-1]}")
        for n in bases:
            for old in ("bases", "base"):
                storage.remove(self.spark, f"{self.root}/{old}/{n}")
        for n in ledger:
            if bases and n <= bases[-1]:
                for old in ("ledger", "batch"):
                    storage.remove(self.spark, f"{self.root}/{old}/{n}")
