"""Exact dedup, hard negatives and clusters against plain versions, with odd rows, ties and skew."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from fabula.llm import ball_tree, exact_dedup, hard_negatives, language_id, sort_means, toxicity

SAME = ["a b", "ab", " ab\n", "a\tb  ", "", None, " \r\n\x0b\x0c", " ab", "A b", "é日本", "é 日本\n", "x" * 200_000, "x " * 200_000]


def test_copies_equal_a_plain_grouping(spark):
    rng = random.Random(2)
    rows = [(None if i % 17 == 0 else rng.randint(0, 300), rng.choice(SAME) if i % 3 else f"own {i}") for i in range(400)] + [(1000 + i, "hot") for i in range(200)]
    df = spark.createDataFrame([(d, t, "x", 1, True) for d, t in rows], "doc_id long, text string, digest string, n_points int, kept boolean").coalesce(1)
    want = sorted(brute.equal_texts(rows), key=repr)
    # shares and sketches of every size give the same rows: all groups heavy, some, none
    for limits in ({}, {"share": 10, "tracked": 8, "most": 4}, {"share": 1}, {"share": 10**9, "tracked": 64, "most": 64}):
        assert sorted(map(tuple, exact_dedup.groups(df, **limits).collect()), key=repr) == want
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns and kept.select("doc_id", "text").distinct().count() == len({rows[i] for i, r in enumerate(brute.equal_texts(rows)) if r[3]})
    assert exact_dedup.groups(df.limit(0)).count() == 0 and exact_dedup.keep_one(df.limit(0)).count() == 0


def test_every_heavy_digest_is_a_candidate(spark):
    rows = spark.range(0, 40_000, 1, 16).select(F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(F.col("id") + 100).alias("digest"))
    assert {r.digest for r in exact_dedup.candidates(rows, 512, 64).collect()} >= set(range(7))


def odd_vectors(n, width, rng, spread=1.0):
    """Vectors with ties, copies of one that a third of the rows hold, equal ids, and rows that take no part."""
    hot = [rng.uniform(-spread, spread) for _ in range(width)]
    rows = [(i, rng.randint(0, 4), hot if i % 3 == 0 else [rng.choice([-spread, 0.0, 0.3, spread]) for _ in range(width)]) for i in range(n)]
    rows += [(5, 1, rows[5][2]), (5, 1, rows[5][2]), (50, 9, hot), (None, 1, hot), (900, None, hot), (901, 1, None), (902, 1, []), (903, 2, [None] * width), (904, 2, [float("nan")] * width), (905, 0, [float("inf")] * width), (906, 3, [1.0])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit(1) for c in ("vec", "slot", "tree", "cluster", "distance", "rank", "score", "block")})


@pytest.mark.parametrize("tree_rows, block", [(8192, 1024), (16, 3)])
def test_hard_negatives_equal_a_plain_search(spark, tree_rows, block):
    rng = random.Random(4)
    rows = odd_vectors(400, 6, rng)
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, F.col("label"), tree_rows=tree_rows, block=block)
    assert sorted(map(tuple, got.collect())) == brute.hard_negatives(rows, lambda i: i % 10 == 0)
    few = frame(spark, rows[:4])
    assert sorted(map(tuple, hard_negatives.mine(few, F.col("vec_id") < 9, F.col("label")).collect())) == brute.hard_negatives(rows[:4], lambda i: i < 9)
    assert hard_negatives.mine(few.limit(0), F.col("vec_id") < 9, F.col("label")).count() == 0
    assert hard_negatives.mine(few, F.col("vec_id") > 9, F.col("label")).count() == 0


def test_hard_negatives_broadcast_no_copies(spark, monkeypatch, capsys):
    seen = []

    def stored(df, tag):
        df.explain()
        seen.append(tag)
        return hard_negatives_stored(df, tag)

    hard_negatives_stored = hard_negatives.stored
    monkeypatch.setattr(hard_negatives, "stored", stored)
    rows = odd_vectors(60, 4, random.Random(6))
    assert hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, F.col("label")).count()
    plans = capsys.readouterr().out
    assert seen == ["labelled", "trees", "positives", "negatives"] and "SortMergeJoin" in plans and "Broadcast" not in plans


@pytest.mark.parametrize("n, width, spread, labels", [(500, 8, 20, 3), (900, 3, 5, 1), (600, 4, 2, 50), (100, 4, 2**26, 2), (60, 4, 2**29, 2), (1, 3, 4, 1), (70, 2, 0, 2)])
def test_a_tree_finds_what_a_scan_finds(n, width, spread, labels):
    rng = np.random.default_rng(n)
    x = rng.integers(-spread, spread + 1, (n, width))
    x[n // 3 : 2 * n // 3] = x[0]
    label, ids, asked = rng.integers(0, labels, n), rng.permutation(n), rng.integers(0, n, 40)
    tree = ball_tree.Tree.unpacked(ball_tree.build(ids, label, x, 8).packed())
    scores = x[asked].astype(object) @ x.T.astype(object)
    for same in (True, False):
        low, high = np.array([[int(s.max()) // 4, int(s.max()) // 2] for s in scores], np.int64).T
        if same:
            low, high = np.full(40, ball_tree.LEAST), np.full(40, ball_tree.MOST)
        own = ball_tree.Asked.of(ids[asked], label[asked], low, high, x[asked], 4)
        computed = ball_tree.search(tree, own, same)
        assert computed <= n * len(asked)
        for q in range(len(asked)):
            fit = [(-int(s), int(i)) for s, i, t in zip(scores[q], ids, label) if i != ids[asked[q]] and (t == label[asked[q]]) == same and low[q] <= s <= high[q]]
            assert [(-int(s), int(i)) for s, i in zip(own.scores[q], own.ids[q]) if s > ball_tree.LEAST] == sorted(fit)[:4]
    if n == 900:
        assert computed == 0  # one label: no node holds a negative


@pytest.mark.parametrize("k, width", [(16, 4), (3, 2), (1000, 3)])
def test_clusters_equal_plain_rounds(spark, k, width):
    rng = random.Random(6)
    rows = odd_vectors(300, width, rng)
    want = brute.clusters([(i, v) for i, _, v in rows], k, width)
    assert sorted(map(tuple, sort_means.clusters(frame(spark, rows), k, width).collect()), key=repr) == sorted(want, key=repr)
    assert sort_means.clusters(frame(spark, rows).limit(0), k, width).count() == 0


def test_far_components_stay_exact_and_scans_stop_early():
    rng = np.random.default_rng(1)
    for spread in (3, 2**20, 2**29):
        x, c = rng.integers(-spread, spread, (200, 3)), rng.integers(-spread, spread, (9, 3))
        c[5] = c[2]
        far = ((x.astype(object)[:, None] - c.astype(object)[None]) ** 2).sum(-1)
        near, least, _ = sort_means.assign(x, rng.integers(0, 9, 200), c)
        assert near.tolist() == [min((d, j) for j, d in enumerate(r))[1] for r in far] and least.tolist() == far.min(1).tolist()
    middle = rng.integers(-(10**6), 10**6, (40, 5))
    x = np.repeat(middle, 10, 0) + rng.integers(-9, 9, (400, 5))
    assert sort_means.assign(x, np.repeat(np.arange(40), 10), middle)[2] == 400  # no other centroid is looked at


def test_a_call_drops_its_own_tables_only(spark):
    """Also those that a nested call has kept, but none of another thread's that is still at work."""
    import threading

    from fabula.llm.shared import passing, stored

    held, go, done = [], threading.Event(), threading.Event()

    def other():
        with passing() as kept:
            held.append(stored(spark.range(3), "other"))
            kept.append(held[0])
            go.set()
            done.wait(60)

    with passing() as kept:
        thread = threading.Thread(target=other)
        thread.start()
        go.wait(60)
        with passing() as inner:
            first, second, third = (stored(spark.range(n), "own") for n in (1, 2, 3))
            inner += [second, third]
        kept.append(third)
    gone = []
    for df in (first, second, third, held[0]):
        try:
            gone.append(df.count() < 0)
        except Exception:
            gone.append(True)
    done.set()
    thread.join()
    assert gone == [True, True, False, False] and held[0].count() == 3


def test_every_language_of_many_is_learned(spark):
    """More languages than a small sample gives one text each."""
    rng = random.Random(3)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    rows = [(n * 40 + i, " ".join(rng.choice(letters[n * 9 : n * 9 + 9]) * rng.randint(1, 3) for _ in range(30)), f"l{n:03}", "s") for n in range(300) for i in range(12 if n else 400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counts = {r.lang: r["count"] for r in language_id.sampled(table, "doc_id", "lang", 400, 600).groupBy("lang").count().collect()}
    assert len(counts) == 300 and min(counts.values()) >= 1 and sum(counts.values()) < 1200
    model = language_id.fit(table, F.col("doc_id") % 3 != 1)
    assert len(model.languages) == 300
    got = language_id.predict(table, model).join(table.select("doc_id", "lang"), "doc_id").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert got > 0.9


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fitted_clauses_keep_their_order(spark, seed):
    """Aimed above bare, bare above negated and reported, for every word of the lexicon; even where labelled rows hold bare words alone."""
    rng = random.Random(seed)
    mild = "the of and a stone river walks under green light with paper hill cloud tree path over again".split()
    rows, labels = [], []
    for i in range(300):
        words = [rng.choice(mild) for _ in range(20)]
        if i % 4 == 0:
            words[rng.randrange(20)] = rng.choice(["dolt", "cretin", "blazzok"])
        if seed == 2:  # every insult is reported, or may be negated
            words.insert(0, rng.choice(["not", "said"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    grammar = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    words = [w.decode() for w in grammar.entries if not w.endswith(b"*")]
    assert {"dolt", "cretin", "blazzok"} <= set(words)
    for w in words:
        texts = [f"you are such a {w}", f"the {w} was near them", f"stone and {w} and hill", f"this is not a {w}", f"someone said {w}"]
        raw = [t.encode() for t in texts]
        off = np.cumsum([0, *map(len, raw)])
        direct, aimed, bare, negated, reported = grammar.score(grammar.sums(np.frombuffer(b"".join(raw), np.uint8), off)[0])
        assert direct > aimed > bare > max(negated, reported)
