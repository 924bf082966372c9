import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from fabula.operators import conversation, graph, model_calls, profiles, tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    delta = spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    once = tables.upsert(base, delta, ["k"])
    assert rows(once) == [(1, "a"), (2, "B"), (3, "C")] == rows(tables.upsert(once, delta, ["k"]))


def test_insert_ignore_lets_null_keys_in(spark):
    base = spark.createDataFrame([(1, 0)], "k long, n long")
    delta = spark.createDataFrame([(1, 1), (2, 2), (2, 3), (None, 4), (None, 5)], "k long, n long")
    assert rows(tables.insert_ignore(base, delta, ["k"], F.col("n"))) == [(1, 0), (2, 2), (None, 4), (None, 5)]


def test_replace_patch_cascade(spark):
    base = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "s long, v long")
    assert rows(tables.replace_all(base, spark.createDataFrame([(1, 9)], "s long, v long"), ["s"])) == [(1, 9), (2, 3)]
    changes = spark.createDataFrame([(2, None, "z")], "v long, s long, extra string").select("v", "s")
    assert rows(tables.patch(base, changes, "v")) == rows(base)
    left = tables.delete_cascade({"a": base, "b": base}, base.where("s = 1"), "s", {"a": "s"})
    assert rows(left["a"]) == [(2, 3)] and left["b"].count() == 3


def test_pages_cover_all_rows_once(spark):
    df = spark.range(23)
    got = [r.id for p in range(1, 5) for r in tables.page(df, p, 7, F.col("id")).collect()]
    assert got == list(range(23))


def test_cooccurrence_is_symmetric(spark):
    df = spark.createDataFrame([(1, 1, i, n) for i, n in enumerate("abacb")], "s long, d long, p long, n string")
    got = {(r.source, r.target): r.weight for r in graph.cooccurrence(df, ["s"], "d", "p", "n", reach=2).collect()}
    assert got == {("a", "b"): 3, ("a", "c"): 1, ("b", "c"): 2}


def test_profiles_take_first_and_longest(spark):
    df = spark.createDataFrame([("Ann ", 1, "", "xx"), ("ann", 2, "lead", "xxxx"), ("ANN", 3, "side", "yyyy")], "name string, seq long, role string, description string")
    r = profiles.merge_profiles(df, ["role"]).first()
    assert (r.name, r.role, r.description, r.fragments) == ("Ann", "lead", "xxxx", 3)


def test_conversation_window(spark):
    df = spark.createDataFrame([(1, t, "user", "x" * 40) for t in range(5)] + [(2, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    plan = conversation.window_plan(df, 2, 20)
    assert {(r.conv_id, r.turn): r.part for r in plan.collect()} == {**{(1, t): "keep" if t > 2 else "compress" for t in range(5)}, (2, 0): "keep"}


def test_summaries_and_retries(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 1, "one. x"), (1, 2, "two. y"), (2, 1, "alone. z"), (3, 1, None)], "k long, o long, text string")
    assert rows(model_calls.summarise(chunks, "k", "o", "text").select("k", "parts", "summary")) == [(1, 2, "one two"), (2, 1, "alone"), (3, 1, "")]
    assert model_calls.embed(chunks, "k", "text").first().dim == 8
    items = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "k long, prompt string")

    def model(r):
        return lambda ts: [f"good {t}" if int(t[1:]) <= 2 * r else "bad" for t in ts]

    def store(df, r):
        df.write.parquet(str(tmp_path / f"r{r}"))
        return spark.read.parquet(str(tmp_path / f"r{r}"))

    got = {r.k: (r.attempts, r.needs_review) for r in model_calls.retry_loop(items, "k", "prompt", model, lambda df: df.withColumn("ok", F.col("reply").startswith("good")), store).collect()}
    assert got == {0: (1, False), 1: (2, False), 2: (2, False), 3: (3, False), 4: (3, False), 5: (3, True)}
    memo = spark.createDataFrame([("x", "r")], "text string, reply string").select(F.sha2("text", 256).alias("digest"), "reply")
    hits, misses = model_calls.memoised(spark.createDataFrame([("x",), ("y",)], "text string"), memo)
    assert [r.text for r in hits.collect()] == ["x"] and [r.text for r in misses.collect()] == ["y"]


def test_numbers_do_not_depend_on_spans(spark):
    df = spark.createDataFrame([(i % 3, i * 7) for i in range(200)], "k long, id long")
    want = {(r.k, r.id): r.no for r in df.withColumn("no", F.row_number().over(Window.partitionBy("k").orderBy("id"))).collect()}
    for span in (1, 50, 10_000):
        assert {(r.k, r.id): r.no for r in tables.numbered(df, ["k"], "id", "no", span).collect()} == want


def test_pages_know_their_total(spark):
    df = spark.range(23)
    assert {(r.total, r.pages) for r in tables.page_with_total(df, 4, 7, F.col("id")).collect()} == {(23, 4)}
    assert [r.id for r in tables.page_with_total(df, 4, 7, F.col("id")).collect()] == [21, 22] and not tables.page_with_total(df, 5, 7, F.col("id")).collect()
    assert not tables.page_with_total(df.limit(0), 1, 7, F.col("id")).collect()


def test_lines_that_are_left_out_are_counted(spark):
    df = spark.createDataFrame([(k, i, f"t{i}") for k, n in ((1, 5), (2, 3)) for i in range(1, n + 1)], "k long, no long, t string")
    got = rows(tables.head_tail(df, "k", "no", "t", 2, 1))
    assert got == [(1, 1, "t1"), (1, 2, "t2"), (1, 3, "...（中间省略 2 章）..."), (1, 5, "t5"), (2, 1, "t1"), (2, 2, "t2"), (2, 3, "t3")]


def test_scopes_fields_and_chains(spark):
    base = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "s long, v long")
    none = base.limit(0)
    assert rows(tables.replace_all(base, none, ["s"], base.where("s = 1"))) == [(2, 3)] and tables.replace_all(base, none, ["s"]).count() == 3
    changes = spark.createDataFrame([(2, None, ["s"]), (3, 7, [])], "v long, s long, fields array<string>")
    assert rows(tables.patch(base, changes, "v", "fields")) == rows(spark.createDataFrame([(1, 1), (None, 2), (2, 3)], "s long, v long"))
    parts = spark.createDataFrame([(1, "a"), (3, "b"), (9, "orphan")], "v long, p string")
    left = tables.delete_cascade({"base": base, "parts": parts}, base.where("s = 1"), "s", {"base": "s"}, {"parts": ("base", "v")})
    assert rows(left["parts"]) == [(3, "b"), (9, "orphan")]
    delta = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, " ", 3)], "k long, t string, n long")
    assert rows(tables.upsert_documents(delta.limit(0), delta, ["k"], "t", F.desc("n"))) == [(1, "new", 2)]
    layer = lambda *kv: spark.createDataFrame(kv, "key string, value string")
    assert rows(tables.layered(layer(("a", "env"), ("b", None)), layer(("b", "file"), ("a", "file")), layer(("c", "own")))) == [("a", "env", 0), ("b", "file", 1), ("c", "own", 2)]


def test_dictionaries_stay_within_their_novel(spark):
    words = spark.createDataFrame([(1, 0, "ann"), (2, 0, "ann"), (1, 1, "sea")], "novel_id long, pos long, token string")
    own = spark.createDataFrame([(1, "ann", "nr"), (1, "ann", "nz")], "novel_id long, word string, flag string")
    assert rows(graph.tagged(words, own, ["novel_id"]).select("novel_id", "token", "flag")) == [(1, "ann", "nr"), (1, "sea", "x"), (2, "ann", "x")]
    entities = spark.createDataFrame([(1, "ann", "item", 1), (1, "ann", "character", 5), (1, "sea", "place", 2)], "novel_id long, name string, type string, id long")
    links = spark.createDataFrame([(1, "ann", "sea", "near"), (1, "ann", "sea", "near"), (1, "ann", "bob", "near")], "novel_id long, source string, target string, type string")
    assert rows(graph.connect(links, entities, ("character", "place", "item"))) == [(1, 5, 2, "near")]


def test_running_sums_and_sought_pages_do_not_depend_on_spans(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i % 3 or None, i * 7 % 1999, rng.choice([None, 0, 5, 11])) for i in range(200)], "k long, id long, n long").withColumn("name", F.lit("x"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    want = {(r.k, r.id): r.b for r in df.where("k is not null").withColumn("b", before).collect()}
    ids = sorted(r.id for r in df.collect())
    for span in (1, 50, 10_000):
        assert {(r.k, r.id): r.b for r in tables.running(df.where("k is not null"), ["k"], "id", F.col("n"), "b", span).collect()} == want
        for page, size in ((1, 7), (5, 40), (6, 40), (29, 7), (2, 1)):
            got = tables.seek(df, page, size, "id", span).orderBy("id").collect()
            assert [(r.id, r.seq) for r in got] == [(x, i + 1) for i, x in enumerate(ids)][(page - 1) * size : page * size]
    assert tables.seek(df.limit(0), 1, 5, "id").count() == 0


def test_what_is_collected_stops_at_the_limit(spark):
    df = spark.createDataFrame([(1, 1, "abcd"), (1, 2, None), (1, 3, "efgh"), (1, 4, "ij"), (2, 9, "xyz")], "k long, no long, t string")
    got = {(r.k, r.no): r.part for r in tables.collect_capped(df, "k", "t", 6, "no").collect()}
    assert got == {(1, 1): "abcd", (1, 2): None, (1, 3): "ef", (2, 9): "xyz"}
