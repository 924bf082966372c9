"""Folders that all executors share, for indexes, ledgers and rounds that are kept between jobs."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LEFT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. A local session alone, as in tests, may do without one: it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="fabula-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    store, p = _at(spark, path)
    return bool(store.exists(p))


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing, if there is none."""
    store, p = _at(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(p)) if store.exists(p) else []


def mark(spark: SparkSession, path: str) -> None:
    """Makes an empty file, all at once; it may be there already."""
    store, p = _at(spark, path)
    store.create(p, True).close()


def remove(spark: SparkSession, path: str) -> None:
    store, p = _at(spark, path)
    store.delete(p, True)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder, which goes when the program ends; a lazy result may read from it until then."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    return path


class Rounds:
    """What the rounds of a computation have written below `root`: a run that is started again reads what is complete, and computes the rest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def done(self) -> list[str]:
        return names(self.spark, f"{self.root}/done")

    def stored(self, df: DataFrame, name: object) -> DataFrame:
        """`df` as it was written under that name, or as it is written now. A write that was interrupted is begun anew."""
        path = f"{self.root}/round/{name}"
        if str(name) not in self.done():
            df.write.mode("overwrite").parquet(path)
            mark(self.spark, f"{self.root}/done/{name}")
        return self.spark.read.schema(df.schema).parquet(path)

    def finish(self) -> None:
        """Removes the rounds; nothing lazy may read from them any more."""
        remove(self.spark, self.root)


@atexit.register
def _remove_all() -> None:
    for path, spark in _LEFT.items():
        with contextlib.suppress(Exception):  # the session has ended: nothing can be reached any more
            remove(spark, path)
