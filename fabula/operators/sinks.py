"""Writing tables and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.functions.text import safe_name
from fabula.sources.files import table_exists


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that `df` holds, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_blobs(df: DataFrame, path: str, content: str = "content") -> None:
    """Appends contents under their SHA-256; what the table has already, or the call holds twice, is written once."""
    new = df.withColumn("key", F.sha2(content, 256)).dropDuplicates(["key"])
    if table_exists(df.sparkSession, path):
        new = new.join(df.sparkSession.read.parquet(path).select("key"), "key", "left_anti")
    new.write.mode("append").parquet(path)


def drop_collection(spark: SparkSession, path: str, kb_id: int) -> None:
    """Removes one base's partition of a table that is partitioned by kb_id; without it nothing happens."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kb_id={int(kb_id)}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: How exports are written as CSV and read: quotes are doubled, and line ends and blanks inside fields kept.
CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}


def export_csv(chunks: DataFrame, path: str, by: str | None = None) -> None:
    """Six columns in (doc_id, idx) order, with a header; of several bases (`by`) a folder each."""
    keys = [by] if by else []
    dealt = chunks.repartitionByRange(*keys, "doc_id", "idx").sortWithinPartitions(*keys, "doc_id", "idx")
    out = dealt.select(*keys, *csv_rows(chunks).columns).write.mode("overwrite").options(**CSV)
    (out.partitionBy(by) if by else out).csv(path)


def read_csv(spark: SparkSession, path: str, by: str | None = None) -> DataFrame:
    """What `export_csv` has written; `by` is the column of the folders, with its type."""
    schema = "chunk_id long, doc_id long, chapter_id long, idx long, word_count long, content string" + (f", {by}" if by else "")
    return spark.read.schema(schema).options(**CSV, multiLine="true", normalizeLineEndings="false").csv(path)


def csv_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "doc_id", "chapter_id", "idx", "word_count", "content")


def json_lines(kb: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kb_id, part, doc_id, idx, line): lines that, in this order, are one object {knowledge_base, chunks[]} for each base.

    No base is gathered into one row: part 0 opens the object, part 1 has a chunk on each line, part 2 closes it.
    """
    none = F.lit(None).cast("long")
    fields = F.to_json(F.struct(*kb.columns))
    opens = kb.select("kb_id", F.lit(0).alias("part"), none.alias("doc_id"), none.alias("idx"), F.concat(F.lit('{"knowledge_base":'), fields, F.lit(',"chunks":[')).alias("line"))
    least = chunks.groupBy("kb_id").agg(F.min(F.struct("doc_id", "idx")).alias("_first"))
    first = F.struct("doc_id", "idx") == F.col("_first")
    chunk = F.to_json(F.struct(*[c for c in chunks.columns if c != "kb_id"]))
    rows = chunks.join(least, "kb_id").select("kb_id", F.lit(1).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.col("idx").cast("long").alias("idx"), F.concat(F.when(first, "").otherwise(","), chunk).alias("line"))
    return opens.unionByName(rows).unionByName(opens.select("kb_id", F.lit(2).alias("part"), "doc_id", "idx", F.lit("]}").alias("line")))


def export_json(kb: DataFrame, chunks: DataFrame, path: str) -> None:
    """The lines of `json_lines` as text, a folder for each base, its files in order."""
    lines = json_lines(kb, chunks.join(kb.select("kb_id"), "kb_id", "left_semi"))
    lines.repartitionByRange("kb_id", "part", "doc_id", "idx").sortWithinPartitions("kb_id", "part", "doc_id", "idx").select("kb_id", "line").write.mode("overwrite").partitionBy("kb_id").text(path)


def read_json_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(kb_id, chunk fields) of what `export_json` has written: a chunk is a line, behind a comma but for the first one."""
    lines = spark.read.schema("value string, kb_id long").text(path).where(F.col("value").rlike("^,?[{]") & ~F.startswith("value", F.lit('{"knowledge_base":')))
    return lines.select("kb_id", F.from_json(F.regexp_replace("value", "^,", ""), schema).alias("c")).select("kb_id", "c.*")


def append_audit(changes: DataFrame, path: str, action: str) -> None:
    """Adds a row for each change (owner_id, target_id) to the log; rows are never changed."""
    audit_rows(changes, action).write.mode("append").parquet(path)


def audit_rows(changes: DataFrame, action: str) -> DataFrame:
    return changes.select("owner_id", F.lit(action).alias("action"), F.col("target_id").cast("string").alias("target"), F.to_json(F.struct(*[c for c in changes.columns if c != "owner_id"])).alias("detail"))


def save_drafts(df: DataFrame, path: str) -> None:
    """(owner_id, novel_id, name, content) below owner and novel, under cleaned names."""
    df.withColumn("name", safe_name(F.col("name"))).write.mode("append").partitionBy("owner_id", "novel_id").parquet(path)
