"""Registered queries on what is written and read back, on streams, and on the small functions around files and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabula import storage
from fabula.functions import text as T
from fabula.operators import model_calls, sinks
from fabula.plans.queries import query
from fabula.sources import files
from fabula.streaming import tasks


@query("""select page_id, split_part(url, '/', -1) as name, lower(regexp_extract(url, '\\.([^./]+)$', 1)) ext, coalesce(nullif(regexp_replace(url, '[^\\p{L}\\p{N}_-]', '', 'g'), ''), 'untitled') safe from pages""", "")
def page_names(v):
    """The last part of an address, its extension, and the address as the name of a file."""
    return v.table("pages").select("page_id", files.base_name(F.col("url")).alias("name"), files.extension(F.col("url")).alias("ext"), T.safe_name(F.col("url")).alias("safe"))


def _cut_sql(limit: int) -> str:
    head = f"substr(text, 1, {limit})"
    last = lambda m: f"(case when instr({head}, {m}) = 0 then 0 else length({head}) - instr(reverse({head}), reverse({m})) - length({m}) + 2 end)"
    marks = ["'" + m.replace("\n", "'||chr(10)||'") + "'" for m in T.CUT_AFTER]
    cuts = " ".join(f"when {last(m)} > 0 and {last(m)} - 1 > {limit} * 0.5 then substr(text, 1, {last(m)})" for m in marks)
    return f"select doc_id, sha256(case when length(text) <= {limit} then text {cuts} else {head} end) cut_sha from documents where text is not null"


@query(_cut_sql(400), "")
def text_cut(v):
    """Texts cut to 400 characters behind the best mark in the second half."""
    return v.table("documents").where("text is not null").select("doc_id", F.sha2(T.cut_at_sentence(F.col("text"), 400), 256).alias("cut_sha"))


_GRAMS = "list_distinct(case when length({0}) < 2 then [{0}] else list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)) end)"


@query(f"""select p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 9) alike from (select p_partkey, {_GRAMS.format("p_name")} a, {_GRAMS.format("p_type")} b from part)""", "")
def bigram_likeness(v):
    """How alike a part's name and type are by their pairs of characters."""
    return v.table("part").select("p_partkey", F.round(T.bigram_jaccard(F.col("p_name"), F.col("p_type")), 9).alias("alike"))


@query("""select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') utc, case when floor(value) = 0 then 0.0 else round((event_id % 97) / floor(value), 9) end ratio from events""", "")
def event_times(v):
    """Times in UTC, whatever the machine's zone, and a ratio that is 0 where nothing is to be divided by."""
    ratio = F.coalesce(F.try_divide((F.col("event_id") % 97).cast("double"), F.floor("value").cast("double")), F.lit(0.0))
    return v.table("events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("utc"), F.round(ratio, 9).alias("ratio"))


@query("""select doc_id, substr(split_part(replace(coalesce(text, ''), chr(10), ' '), '.', 1), 1, 60) reply from documents""", "")
def model_replies(v):
    """A model's reply to each text, asked for in batches."""
    return model_calls.call_model(v.table("documents").select("doc_id", "text"), model_calls.stub_summary, "text", "reply", ["doc_id"])


@query("""select d.doc_id, m.reply is not null hit, coalesce(m.reply, 0) reply from documents d left join (select text, min(doc_id) reply from documents where doc_id % 3 = 0 group by 1) m on m.text = d.text""", "")
def memo_hits(v):
    """Which texts a memo knows by their digests, and what it says of them."""
    docs = v.table("documents").select("doc_id", "text")
    memo = docs.where("doc_id % 3 = 0").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("reply"))
    hits, misses = model_calls.memoised(docs, memo)
    none = misses.withColumns({"hit": F.lit(False), "reply": F.lit(0).cast("long")})
    return hits.withColumn("hit", F.lit(True)).select("doc_id", "hit", "reply").unionByName(none.select("doc_id", "hit", "reply"))


@query("""select sha256(text) as key, count(*) n, max(length(text)) chars from (select distinct text from documents where text is not null) group by 1""", "")
def blob_store(v):
    """Contents under their digests: two appends that overlap leave each content once."""
    path = storage.scratch(v.spark, "blobs") + "/table"
    docs = v.table("documents").where("text is not null").select(F.col("text").alias("content"), F.col("doc_id"))
    for part in ("doc_id % 3 <> 0", "doc_id % 3 <> 1"):
        sinks.write_blobs(docs.where(part).select("content"), path)
    return v.spark.read.parquet(path).groupBy("key").agg(F.count("*").alias("n"), F.max(F.length("content")).cast("long").alias("chars"))


@query("""select novel_id, case when novel_id % 4 = 0 then 'new' else 'old' end version, count(*) n from document where novel_id % 4 <> 0 or doc_id % 2 = 0 group by all""")
def partition_rewrite(v):
    """A table by novels, of which every fourth is replaced by half of its documents; the other folders stay as they are."""
    path = storage.scratch(v.spark, "partitions")
    rows = v.document().select("novel_id", "doc_id", F.lit("old").alias("version"))
    sinks.write_partitions(rows, path, "novel_id")
    sinks.write_partitions(rows.where("novel_id % 4 = 0 and doc_id % 2 = 0").withColumn("version", F.lit("new")), path, "novel_id")
    return v.spark.read.schema("doc_id long, version string, novel_id long").parquet(path).groupBy("novel_id", "version").agg(F.count("*").alias("n"))


@query("""select conv_id, sha256(string_agg(coalesce(text, ''), '' order by turn)) text_sha from conversations group by 1""", "")
def reply_stream(v):
    """Conversations whose turns come as pieces of a stream, joined when the last one has come."""
    root = storage.scratch(v.spark, "replies")
    c = v.table("conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    pieces = c.join(last, "conv_id").select("conv_id", F.col("turn").alias("seq"), F.coalesce("text", F.lit("")).alias("piece"), (F.col("turn") == F.col("last")).alias("done"))
    pieces.repartitionByRange(3, "seq").sortWithinPartitions("seq").write.parquet(f"{root}/log")
    # all pieces in one batch, as files of one write are in no order of time
    source = v.spark.readStream.schema(pieces.schema).parquet(f"{root}/log")
    tasks.replies(source).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.schema("conv_id long, text string").parquet(f"{root}/out").select("conv_id", F.sha2("text", 256).alias("text_sha"))


@query("""select distinct task_id from task_event where status <> 'running'""")
def usage_once_stream(v):
    """Tasks whose usage is written once by a stream, however often their end is sent."""
    root = storage.scratch(v.spark, "usage-once")
    ends = v.task_event().where("status <> 'running'").select("task_id", F.col("seq").alias("tokens_in"), "ts")
    ends.repartition(3, "task_id").write.parquet(f"{root}/log")
    source = v.spark.readStream.schema(ends.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/log")
    tasks.usage_once(source, "400 days").select("task_id").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.schema("task_id long").parquet(f"{root}/out")
