"""What the operators share: the shared folder, tables cut from their lineage, and the order of columns."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Where the tables of this package lie, by the DataFrame that reads them; and those that nobody has dropped yet.
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_LEFT: dict[str, SparkSession] = {}
#: The tables that the innermost `passing` of this call has made; other threads' calls have lists of their own.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. Only a local session, as in tests, may do without one: it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="fabula-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """`df` written to the shared folder and read again: lineage ends there, and a lost executor costs nothing before it."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return _placed(df.sparkSession.read.schema(df.schema).parquet(path), path)


def stored_with_sum(df: DataFrame, tag: str) -> tuple[DataFrame, tuple]:
    """`stored`, and the number of its rows and a sum of their hashes, observed while they are written."""
    seen = Observation()
    digest = F.xxhash64(*df.columns).cast("decimal(38,0)")
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(digest).alias("sum")), tag)
    return out, (seen.get["n"], seen.get["sum"])


def _placed(df: DataFrame, place: str) -> DataFrame:
    _PLACES[df] = place
    _LEFT[place] = df.sparkSession
    if (made := _MADE.get()) is not None:
        made.append(place)
    return df


def drop(*tables: DataFrame) -> None:
    """Removes tables that `stored` or `bucketed` made; what is still to be computed from them must not be lazy."""
    for df in tables:
        _drop_place(_PLACES.pop(df))


def _drop_place(place: str) -> None:
    spark = _LEFT.pop(place)
    if place.startswith("table "):
        spark.sql(f"drop table if exists {place[6:]}")
    else:
        p = spark._jvm.org.apache.hadoop.fs.Path(place)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Tables made inside go at the end, but for those that are put on the list: what a lazy result still reads.

    Those are the surrounding `passing`'s then, if there is one.
    """
    kept: list[DataFrame] = []
    made: list[str] = []
    before = _MADE.set(made)
    try:
        yield kept
    finally:
        _MADE.reset(before)
        named = {_PLACES[df] for df in kept if df in _PLACES}
        for place in made:
            if place in named and (around := _MADE.get()) is not None:
                around.append(place)
            elif place not in named and place in _LEFT:
                _drop_place(place)


@atexit.register
def _drop_all() -> None:
    for place in list(_LEFT):
        with contextlib.suppress(Exception):  # the session has ended: nothing can be reached any more
            _drop_place(place)


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, text string) of `docs`, null text as empty; every other column is left out, so none can clash."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, key: str, tag: str, aligned: bool = False) -> DataFrame:
    """`df` stored once in buckets of `key` in the warehouse: joins on `key` then move only their other side.

    Where tasks times buckets would make very many files, rows are first dealt out by the key, unless they come out of
    a table in the same buckets (`aligned`) and so lie together.
    """
    spark = df.sparkSession
    n = tasks(spark)
    if not aligned and df.rdd.getNumPartitions() * n > 4096:
        df = df.repartition(n, key)
    name = f"{tag}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, key).option("compression", "zstd").saveAsTable(name)
    return _placed(spark.table(name), "table " + name)


def slots(spark: SparkSession) -> list[int]:
    """Numbers that Spark's hash deals to its shuffle partitions, one to each: rows keyed by them lie evenly."""
    n = tasks(spark)
    found = spark.range(0, 24 * n, 1, 1).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).agg(F.min("id").alias("slot"))
    return [r.slot for r in found.orderBy("slot").limit(n).collect()]
