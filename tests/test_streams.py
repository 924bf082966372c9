import time

from pyspark.sql import functions as F

from fabula.fixtures import Views
from fabula.sources import files
from fabula.operators import sinks
from fabula.streaming import tasks

DIR = "/root/testdata/sf0.001"


def run(df, mode, name, tmp_path):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_streams_agree_with_batches(spark, tmp_path):
    batch = Views(spark, DIR).task_event()
    batch.repartition(3).write.parquet(str(tmp_path / "log"))
    source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "log"))
    want = sorted(map(tuple, tasks.progress(batch).collect()))
    assert sorted(map(tuple, run(tasks.progress(source), "complete", "progress", tmp_path).collect())) == want
    ends = run(tasks.terminal_once(source, "400 days"), "append", "ends", tmp_path)
    terminal = batch.where(F.col("status").isin(*tasks.TERMINAL)).select("task_id", "status").distinct()
    assert sorted(map(tuple, ends.select("task_id", "status").collect())) == sorted(map(tuple, terminal.collect()))


def test_replies_come_when_done(spark, tmp_path):
    rows = [(1, 0, "Hel", False), (2, 0, "open", False), (1, 1, "lo", True)]
    for part in (rows[:2], rows[2:]):  # a conversation's pieces come in their order
        spark.createDataFrame(part, "conv_id long, seq long, piece string, done boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "pieces"))
        time.sleep(1.1)
    source = spark.readStream.schema("conv_id long, seq long, piece string, done boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pieces"))
    assert [tuple(r) for r in run(tasks.replies(source), "append", "replies", tmp_path).collect()] == [(1, "Hello")]


def test_open_replies_are_kept_as_lists_over_many_batches(spark, tmp_path):
    rng = __import__("random").Random(2)
    sent = {c: [f"{c}-{i} " for i in range(n)] for c, n in ((1, 12), (2, 3), (3, 7))}
    rows = [(c, i, p, c != 3 and i == len(ps) - 1) for c, ps in sent.items() for i, p in enumerate(ps)]
    late = {c: rng.sample(range(len(ps) - 1), len(ps) - 1) for c, ps in sent.items()}  # the last piece comes last, the others in any order
    rows = sorted(rows, key=lambda r: (late[r[0]] + [99])[r[1]] if r[1] < len(late[r[0]]) else 99)
    for i in range(0, len(rows), 4):
        spark.createDataFrame(rows[i : i + 4] + rows[i : i + 1][:1], "conv_id long, seq long, piece string, done boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "pieces"))
        time.sleep(1.1)
    source = spark.readStream.schema("conv_id long, seq long, piece string, done boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pieces"))
    got = [tuple(r) for r in run(tasks.replies(source), "append", "many_replies", tmp_path).collect()]
    assert sorted(got) == [(c, "".join(sent[c])) for c in (1, 2)]


def test_the_first_dictionary_that_there_is_counts(spark, tmp_path):
    for d, word in (("b", "乙词"), ("c", "丙词")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "novel_dict.txt").write_text(f"{word} 3 nr\n", encoding="utf-8")
    (tmp_path / "own.txt").write_text("甲词 2 nr\n", encoding="utf-8")
    folders = [str(tmp_path / d) for d in "abc"]
    words = lambda configured, folders=folders: [r.word for r in files.found_dictionary(spark, configured, folders).collect()]
    assert words(str(tmp_path / "own.txt")) == ["甲词"] and words(str(tmp_path / "none.txt")) == ["乙词"] and words(None, folders[2:]) == ["丙词"] and words(None, folders[:1]) == []


def test_uploads_and_dictionary(spark, tmp_path):
    d = tmp_path / "up"
    d.mkdir()
    (d / "a.txt").write_bytes("héllo".encode() + b"\xff")
    (d / "b.txt").write_bytes("héllo".encode() + b"\xff")
    (d / "c.exe").write_bytes(b"x")
    (d / "d.txt").write_bytes(b"  ")
    got = {r.name: (r.text, r.error) for r in files.uploads(spark, str(d)).collect()}
    assert got == {"a.txt": ("héllo", None), "b.txt": (None, "duplicate"), "c.exe": (None, "unsupported"), "d.txt": (None, "empty")}
    (tmp_path / "dict.txt").write_text("# note\n\n林黛玉 10 nr\nascii 1 n\n大观园 5 ns\n", encoding="utf-8")
    assert sorted(map(tuple, files.dictionary(spark, str(tmp_path / "dict.txt")).collect())) == [("大观园", 5, "ns"), ("林黛玉", 10, "nr")]


def test_partition_overwrite(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 1), (2, 2)], "kb_id long, v long")
    sinks.write_partitions(df, p, "kb_id")
    sinks.write_partitions(spark.createDataFrame([(2, 9)], "kb_id long, v long"), p, "kb_id")
    assert sorted((r.kb_id, r.v) for r in spark.read.parquet(p).collect()) == [(1, 1), (2, 9)]


def test_progress_until_the_end(spark, tmp_path):
    batch = Views(spark, DIR).task_event()
    batch.orderBy("seq").coalesce(1).write.parquet(str(tmp_path / "log"))
    source = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "log"))
    got = run(tasks.until_terminal(source, "400 days"), "append", "until", tmp_path)
    ends = {r.task_id: r.seq for r in batch.where(F.col("status").isin(*tasks.TERMINAL)).groupBy("task_id").agg(F.min("seq").alias("seq")).collect()}
    want = sorted((r.task_id, r.seq, r.status) for r in batch.collect() if r.seq <= ends.get(r.task_id, r.seq))
    assert sorted(map(tuple, got.collect())) == want
    rows = spark.createDataFrame([(1, 5, "failed", None), (2, 6, "success", None), (3, 7, "failed", None)], "task_id long, seq long, status string, ts timestamp")
    assert [(r.task_id, r.seq, r.status) for r in tasks.retries(rows, rows.where("task_id < 3")).collect()] == [(1, 6, "running")]


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = Views(spark, DIR).task_event().where("task_id is not null")
    for i in (0, 1):
        rows.where(f"seq % 2 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "log"))
        query = tasks.usage_once(source, "400 days").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        query.start(str(tmp_path / "out")).awaitTermination()  # the second run is a restart
    got = [r.task_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) == rows.select("task_id").distinct().count()


def test_trend_by_week_and_day(spark, tmp_path):
    usage = Views(spark, DIR).usage().withColumnRenamed("created_at", "ts").select("ts", "tokens_in")
    usage.write.parquet(str(tmp_path / "log"))
    source = spark.readStream.schema(usage.schema).parquet(str(tmp_path / "log"))
    got = run(tasks.trend(source, "week", "1 day"), "complete", "trend", tmp_path)
    want = usage.groupBy(F.date_trunc("week", "ts").alias("bucket")).agg(F.sum("tokens_in").alias("tokens_in"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_blobs_drafts_exports_and_logs(spark, tmp_path):
    blobs, out = str(tmp_path / "blobs"), str(tmp_path / "kb")
    for _ in range(2):
        sinks.write_blobs(spark.createDataFrame([("a",), ("b",), ("a",)], "content string"), blobs)
    sinks.write_blobs(spark.createDataFrame([("b",), ("c",)], "content string"), blobs)
    assert sorted(r.content for r in spark.read.parquet(blobs).collect()) == ["a", "b", "c"]
    sinks.write_partitions(spark.createDataFrame([(1, 1), (2, 2)], "kb_id long, v long"), out, "kb_id")
    for _ in range(2):
        sinks.drop_collection(spark, out, 2)
    assert [r.v for r in spark.read.parquet(out).collect()] == [1]
    drafts = spark.createDataFrame([(1, 2, "my/draft!", "text")], "owner_id long, novel_id long, name string, content string")
    sinks.save_drafts(drafts, str(tmp_path / "drafts"))
    assert [r.name for r in spark.read.parquet(str(tmp_path / "drafts")).collect()] == ["mydraft"]
    d = tmp_path / "files" / "1" / "2"
    d.mkdir(parents=True)
    (d / "one.txt").write_text("héllo")
    root = str(tmp_path / "files")
    assert [r.path.endswith("one.txt") for r in files.drafts(spark, root, 1, 2).collect()] == [True]
    assert [r.text for r in files.draft_text(spark, root, 1, 2, "1/2/one.txt").collect()] == ["héllo"]
    assert not files.draft_text(spark, root, 7, 2, "1/2/one.txt").collect() and not files.draft_text(spark, root, 1, 2, "1/2/none.txt").collect()
    names = spark.createDataFrame([("1/2/one.txt",), ("x.txt",)], "path string")
    assert {r.path: r.exists for r in files.present(names, spark, root).collect()} == {"1/2/one.txt": True, "x.txt": False}
    known = files.uploads(spark, root).select("file_hash", F.lit(False).alias("deleted"))
    assert [r.error for r in files.uploads(spark, root, existing=known).collect()] == ["duplicate"]
    assert [r.error for r in files.uploads(spark, root, existing=known.withColumn("deleted", F.lit(True))).collect()] == [None]
    assert [r.error for r in files.uploads(spark, root, {"txt": 3}).collect()] == ["too large"]
    sinks.append_audit(spark.createDataFrame([(1, 5, "n")], "owner_id long, target_id long, note string"), str(tmp_path / "log"), "note")
    sinks.append_audit(spark.createDataFrame([(1, 6, "n")], "owner_id long, target_id long, note string"), str(tmp_path / "log"), "note")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_exports_are_files(spark, tmp_path):
    import json

    kb = spark.createDataFrame([(1, "one"), (2, "none")], "kb_id long, name string")
    chunks = spark.createDataFrame([(1, i, i // 3, None, i % 3, 2, f'a "{i}"\n') for i in range(7)], "kb_id long, chunk_id long, doc_id long, chapter_id long, idx long, word_count long, content string")
    sinks.export_json(kb, chunks, str(tmp_path / "json"))
    for k, n in ((1, 7), (2, 0)):
        text = "\n".join(p.read_text() for p in sorted((tmp_path / "json" / f"kb_id={k}").glob("part-*")))
        whole = json.loads(text)
        assert whole["knowledge_base"]["kb_id"] == k and [c["chunk_id"] for c in whole["chunks"]] == list(range(n))
    sinks.export_csv(chunks, str(tmp_path / "csv"))
    back = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(str(tmp_path / "csv"))
    assert back.columns == ["chunk_id", "doc_id", "chapter_id", "idx", "word_count", "content"] and sorted(r.content for r in back.collect()) == [f'a "{i}"\n' for i in range(7)]
