import random

from pyspark.sql import functions as F

from fabula.functions import folds
from fabula.operators import knn, rules


def test_sentence_cuts_cover_the_text(spark):
    rng = random.Random(3)
    for size, overlap in ((10, 3), (7, 0), (1, 0), (5, 4)):
        for _ in range(60):
            t = "".join(rng.choice("ab.\n") for _ in range(rng.randint(0, 60)))
            cuts = folds.sentence_cuts(t, size, overlap, ".\n")
            assert (not t and not cuts) or (cuts[0][0] == 0 and cuts[-1][1] == len(t))
            assert all(0 < b - a <= size for a, b in cuts) and all(a2 <= b1 and a2 > a1 for (a1, b1), (a2, _) in zip(cuts, cuts[1:]))
    got = spark.createDataFrame([("ab. cd. ef",), (None,)], "t string").select(folds.sentence_chunks(F.col("t"), 5, 0, ".").alias("c")).collect()
    assert [[(x.start, x.stop) for x in r.c] for r in got] == [[(0, 5), (5, 10)], []]


def test_excerpts(spark):
    df = spark.createDataFrame([("x" * 49 + " Ann met Bob. " + "Annie " * 9, "Ann", "Bob"), ("nothing", "Ann", "Bob"), (None, None, None)], "t string, a string, b string")
    one = [r.c for r in df.select(folds.name_context(F.col("t"), F.col("a"), 5, 12, 400).alias("c")).collect()]
    assert one == ["xxxx Ann met Bob.", "nothing", ""]
    two = [r.c for r in df.select(folds.pair_context(F.col("t"), F.col("a"), F.col("b"), 2, 12, 100).alias("c")).collect()]
    assert two == ["x Ann met Bob.", "nothing", ""]


def test_profiles_are_judged(spark):
    rows = [("a", "主角", "king", "rules the land"), ("b", "hero", "x", "y"), ("c", "配角", " ", "y"), ("d", "配角", "x", "z" * 200), ("e", "主角", "heir", "rules the land"), ("f", None, None, None)]
    df = spark.createDataFrame(rows, "name string, role string, identity string, description string")
    assert {r.name: r.reason for r in rules.judge_profiles(df).collect()} == {"a": None, "b": "role", "c": "identity", "d": "description", "e": "duplicate", "f": "role"}


def test_alike_profiles_are_found_whatever_lies_between(spark):
    rng = random.Random(21)
    text = lambda n: "".join(rng.choice("abcdefghij的了山水") for _ in range(n))
    rows = [("a", "主角", "x", "the same words of one and the same length"), ("b", "主角", "x", "other words that have the very same length"[:41]), ("c", "主角", "x", "the same words of one and the same length")]
    rows += [(rng.choice(("m", "n", "o", None)), rng.choice(("主角", "配角", "反派")), "x", text(rng.choice((1, 2, 3, 9, 10, 11, 40, 41, 90, 148, 150)))) for _ in range(90)]
    for _ in range(150):
        name, role, _, d = rng.choice(rows)
        i = rng.randint(0, len(d))
        d = (d, d[:i] + text(1) + d[i:], d[:i] + text(1) + d[i + 1 :], d + text(rng.randint(0, 9)), d[: -rng.randint(1, 9)])[rng.randint(0, 4)]
        rows.append((rng.choice((name, "m", "p", None)), rng.choice((role, role, "配角")), rng.choice(("x", "y", "")), d))
    rows += rows[:20]
    sets = [{d[i : i + 2] for i in range(len(d) - 1)} or {d} for _, _, _, d in rows]
    key = lambda i: (len(rows[i][3]), rows[i][0] is not None, rows[i][0] or "", rows[i][3], rows[i][2], i)
    want = []
    for i, (name, role, identity, d) in enumerate(rows):
        alike = any(rows[j][1] == role and key(j) < key(i) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > 0.9 for j in range(len(rows)))
        want.append((name, role, identity, d, "identity" if not identity else "description" if not 1 <= len(d) <= 150 else "duplicate" if alike else None))
    rng.shuffle(rows)
    got = rules.judge_profiles(spark.createDataFrame(rows, "name string, role string, identity string, description string")).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got) and all(r.ok == (r.reason is None) for r in got)
    assert [r.reason for r in got if r.name == "c"] == ["duplicate"] * 2 and sum(w[4] == "duplicate" for w in want) > 60


def test_nearest_asks_many_queries_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    vectors = [(i, [rng.randint(0, 9) / 2 for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    monkeypatch.setattr(knn, "QUERIES", 10)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in knn.nearest(df, df.where("vec_id < 35"), 3).collect())
    want = []
    for q, x in vectors[:35]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), i) for i, y in vectors if i != q)[:3]
        want += [(q, n + 1, i) for n, (_, i) in enumerate(near)]
    assert got == want


def test_every_keyword_is_looked_for(spark):
    errors = spark.createDataFrame([("Word 7 failed, word 1490 too",), ("none",), (None,)], "error string")
    keywords = spark.createDataFrame([(f"WORD {i} ", str(i), -i) for i in range(1500)], "keyword string, message string, priority int")
    assert [r.message for r in rules.user_error(errors, keywords).collect()] == ["1490", "系统错误：none", "系统错误：未知错误，请稍后重试"]
    assert [r.message for r in rules.user_error(errors, keywords.limit(0)).collect()] == ["系统错误：Word 7 failed, word 1490 too", "系统错误：none", "系统错误：未知错误，请稍后重试"]
