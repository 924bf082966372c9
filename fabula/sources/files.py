"""Uploads, drafts and word lists as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.functions.text import decoded

#: What may be uploaded, and the largest size in bytes.
EXTENSIONS = {"txt": 50 << 20, "md": 200 << 20, "epub": 200 << 20, "pdf": 200 << 20, "docx": 200 << 20}
#: The same for what is attached to a conversation.
ATTACHMENTS = {e: 5 << 20 for e in EXTENSIONS}


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """In lower case; empty without any."""
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def present(names: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """`names` (path, relative to `root`) with `exists`, from one listing of the store."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.substring_index("path", root.rstrip("/") + "/", -1).alias("path"), F.lit(True).alias("exists"))
    return names.join(there, "path", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def uploads(spark: SparkSession, path: str, limits: dict[str, int] = EXTENSIONS, existing: DataFrame | None = None) -> DataFrame:
    """(path, name, ext, length, file_hash, text, error) of the files below `path`.

    A bad file is a row with an error, and no reason for others to fail. Sizes and extensions are judged before
    contents are decoded; bytes that are not UTF-8 are left out. Of files with one hash all but the first path are
    `duplicate`, and so is one whose hash `existing` (file_hash, deleted; one novel's documents) has and has not deleted.
    Spark's reader passes over files of no bytes at all.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = raw.withColumns({"name": base_name(F.col("path")), "ext": extension(F.col("path"))})
    most = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    limit = F.try_element_at(most, F.col("ext"))
    error = F.when(limit.isNull(), "unsupported").when(F.col("length") > limit, "too large").when(F.trim(decoded(F.col("content"))) == "", "empty")
    judged = named.withColumns({"error": error, "file_hash": F.sha2("content", 256)})
    first = judged.where("error is null").groupBy("file_hash").agg(F.min("path").alias("first_path"))
    out = judged.join(first, "file_hash", "left").withColumn("error", F.coalesce("error", F.when(F.col("path") != F.col("first_path"), "duplicate")))
    if existing is not None:
        known = existing.where("not deleted").select("file_hash").distinct().withColumn("known", F.lit(True))
        out = out.join(known, "file_hash", "left").withColumn("error", F.coalesce("error", F.when(F.col("known"), "duplicate")))
    return out.select("path", "name", "ext", "length", "file_hash", F.when(F.col("error").isNull(), decoded(F.col("content"))).alias("text"), "error")


def drafts(spark: SparkSession, root: str, owner: int, novel: int) -> DataFrame:
    """Listing of an owner's saved text files of one novel."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(f"{root}/{owner}/{novel}")
    return raw.select("path", "length", F.col("modificationTime").alias("modified"))


def draft_text(spark: SparkSession, root: str, owner: int, novel: int, key: str) -> DataFrame:
    """(path, text) of one saved draft; no row for a key outside the owner's and the novel's folder."""
    prefix = f"{owner}/{novel}/"
    if not key.startswith(prefix) or ".." in key.split("/") or not table_exists(spark, f"{root}/{key}"):
        return spark.createDataFrame([], "path string, text string")
    return spark.read.format("binaryFile").load(f"{root}/{key}").select("path", decoded(F.col("content")).alias("text"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq, tag) of a word list; blank lines, and lines that begin with an ASCII word (comments too), are skipped."""
    parts = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.get(parts, 0).alias("word"), F.get(parts, 1).cast("long").alias("freq"), F.get(parts, 2).alias("tag"))
    return rows.where(~F.col("word").rlike("^[\\x00-\\x7F]+$"))


def find_dictionary(spark: SparkSession, configured: str | None, folders: list[str], name: str = "novel_dict.txt") -> str | None:
    """Where a word list lies: the path that is configured, if there is a file, or else the first of the folders that has one."""
    places = ([configured] if configured else []) + [f"{f.rstrip('/')}/{name}" for f in folders]
    return next((p for p in places if table_exists(spark, p)), None)


def found_dictionary(spark: SparkSession, configured: str | None, folders: list[str], name: str = "novel_dict.txt") -> DataFrame:
    """`dictionary` of the list that `find_dictionary` finds; without any, no words."""
    path = find_dictionary(spark, configured, folders, name)
    return dictionary(spark, path) if path else spark.createDataFrame([], "word string, freq long, tag string")


def seeded(existing: DataFrame, rows: list[tuple], keys: list[str]) -> DataFrame:
    """`existing` and those fixed rows whose keys it lacks."""
    spark = existing.sparkSession
    new = spark.createDataFrame(rows, existing.schema).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(new.select(*existing.columns))
