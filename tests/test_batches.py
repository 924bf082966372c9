"""What an operator holds of one large batch: not what all its rows give together."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from fabula.functions.segment import Words
from fabula.operators import graph, knn, model_calls, text_index, vector_index, words
from fabula.plans.story import QUERIES


@pytest.fixture
def held(spark, monkeypatch):
    """MB that Python and Arrow hold at most while an operator's last function goes through all rows as one batch, and the batches that it gives."""

    def of(make):
        seen, kind = [], type(spark.range(1))
        with monkeypatch.context() as m:
            m.setattr(kind, "mapInArrow", lambda self, f, schema, *a, real=kind.mapInArrow, **b: (seen.append((self, f)), real(self, f, schema, *a, **b))[1])
            make()
        df, f = seen[-1]
        whole, given = df.toArrow().combine_chunks().to_batches()[0], []
        plain, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
        pa.set_memory_pool(pool)
        tracemalloc.start()
        try:
            for b in f(iter([whole])):
                given.append((b.num_rows, b.nbytes))
                del b
            return (tracemalloc.get_traced_memory()[1] + pool.max_memory()) / 1e6, given
        finally:
            tracemalloc.stop()
            pa.set_memory_pool(plain)

    return of


NAMES = [f"name{i}x" for i in range(20)]


def stories(spark, n=400):
    """Texts of about 12 KB that hold all names."""
    rng = random.Random(3)
    rows = [(i, 1, " ".join(rng.choice([*NAMES, "of", "the", "words", "sea"]) for _ in range(2000)) + " " + " ".join(NAMES)) for i in range(n)]
    return spark.createDataFrame(rows, "doc long, novel long, text string")


def test_pairs_of_a_large_batch_are_sent_in_pieces(spark, held):
    pairs = spark.createDataFrame([(1, a, b) for a, b in zip(NAMES, NAMES[1:])], "novel long, source string, target string")
    mb, given = held(lambda: words.pair_contexts(stories(spark), ["doc"], "text", pairs, "novel"))
    assert sum(n for n, _ in given) == 400 * 19 and max(x for _, x in given) < 3e6 and mb < 20


def test_nearest_meets_blocks_and_not_pairs(spark, monkeypatch, capsys):
    rng = random.Random(8)
    rows = [(i, [rng.randint(0, 5) / 4 for _ in range(4)]) for i in range(90)]
    rows += [(90, None), (91, [0.5]), (92, [1.0]), (93, []), (94, []), (95, [float("nan"), 0.0, 0.0, 0.0]), (96, [float("inf"), 0.0, 0.0, 0.0]), (97, [None, 0.0, 0.0, 0.0]), (98, [1e200, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def far(x, y):  # nulls come first, nan last
        if any(a is None or b is None for a, b in zip(x, y)):
            return (0, 0.0)
        d = sum((a - b) * (a - b) for a, b in zip(x, y))
        return (1, d) if d == d else (2, 0.0)

    want = [(q, n + 1, i) for q, x in rows if x is not None and (q < 40 or q > 90) for n, (_, i) in enumerate(sorted((far(x, y), i) for i, y in rows if i != q and y is not None and len(y) == len(x))[:3])]
    monkeypatch.setattr(knn, "BLOCK", 16)
    got = knn.nearest(df, df.where("vec_id < 40 or vec_id >= 90"), 3)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == sorted(want)
    got.explain()
    assert "MapInArrow" in capsys.readouterr().out


@pytest.mark.parametrize("block, held, k", [(4096, 5_000_000, 3), (16, 60, 3), (16, 60, 1), (2, 9, 30)])
def test_many_queries_meet_all_vectors_in_parts(spark, monkeypatch, capsys, block, held, k):
    rng = random.Random(8)
    hot = [0.25, 0.5, 0.0, 1.0]
    rows = [(i, [rng.randint(0, 5) / 4 for _ in range(4)] if i % 3 else hot) for i in range(90)] + [(5, hot), (6, hot), (6, hot)]
    rows += [(90, None), (91, [0.5]), (92, [1.0]), (93, []), (94, []), (95, [float("nan"), 0.0, 0.0, 0.0]), (96, [float("inf"), 0.0, 0.0, 0.0]), (97, [None, 0.0, 0.0, 0.0]), (98, [1e200, 0.0, 0.0, 0.0]), (99, [float("nan")] * 4), (None, hot)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    few = sorted(map(repr, knn.nearest(df, df, k).collect()))
    for name, n in (("QUERIES", 5), ("BLOCK", block), ("ASKED", 8), ("HELD", held)):
        monkeypatch.setattr(knn, name, n)
    got = knn.nearest(df, df, k)
    assert sorted(map(repr, got.collect())) == few
    got.explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_every_vector_is_a_query(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert QUERIES["vec_knn_all"](spark, "/root/testdata/sf0.001").count() == 3 * e.count()


def test_a_sample_is_cut_before_it_is_sent(spark):
    rows = spark.range(20_000).repartition(16)
    taken = vector_index.sampled(rows, 20_000, 500)
    assert 450 <= taken.count() <= 500 and taken.rdd.getNumPartitions() == 1
    assert vector_index.sampled(rows, 20_000, 30_000).count() == 20_000
    near = [r.id for r in taken.collect()]
    assert sorted(near) == sorted(r.id for r in vector_index.sampled(rows.repartition(3), 20_000, 500).collect())


def test_cells_are_met_without_a_broadcast_of_pairs(spark, monkeypatch, tmp_path, capsys):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (600, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(vector_index, "BLOCK", 64)
    monkeypatch.setattr(vector_index, "ASKED", 16)
    monkeypatch.setattr(vector_index, "PAIRS", 40, raising=False)
    vector_index.build(df, str(tmp_path), cells=12)
    blocks = spark.read.parquet(f"{tmp_path}/blocks").groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("rows")).collect()
    assert sum(r.rows for r in blocks) == 600 and all(r.n <= -(-r.rows // 64) for r in blocks)
    got = vector_index.search(spark, str(tmp_path), df.where("vec_id % 3 = 0"), 3)
    far = ((x[::3, None] - x[None]) ** 2).sum(2)
    want = [(3 * q, int(v)) for q, d in enumerate(far) for v in np.argsort(np.where(np.arange(600) == 3 * q, np.inf, d))[:3]]
    assert sorted((r.query_id, r.vec_id) for r in got.collect()) == sorted(want)
    got.explain()
    joins = [x for x in capsys.readouterr().out.split("\n") if "Join" in x and "cell#" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_mentions_of_a_large_batch_take_no_texts_along(spark, held):
    names = spark.createDataFrame([(1, n) for n in NAMES], "novel long, name string")
    mb, given = held(lambda: words.mentions(stories(spark), ["doc"], "text", names, "novel"))
    assert sum(n for n, _ in given) == 400 * 20 and mb < 12


def test_what_mentions_hold_does_not_grow_with_the_batch(spark, held):
    names = spark.createDataFrame([(1, n) for n in NAMES], "novel long, name string")
    (few, _), (many, given) = (held(lambda n=n: words.mentions(stories(spark, n), ["doc"], "text", names, "novel")) for n in (150, 600))
    assert sum(n for n, _ in given) == 600 * 20 and many < 1.3 * few


@pytest.mark.parametrize("query", ["drama_cast_block", "drama_cast", "drama_cast_ranked", "appearance_count", "drama_detail"])
def test_queries_on_casts_hold_a_slice_of_the_chapters(spark, held, monkeypatch, tmp_path, query):
    rng, letters = random.Random(5), ["harbor", "marsh", "tower", "mill", "river", "stone", "garden", "bridge", *["sunlight", "of"] * 16]

    def of(n):
        rows = [(i, " ".join(rng.choice(letters) for _ in range(2200)), "en", "src1", 0) for i in range(n)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{n}/documents.parquet")
        asked, mentions = [], words.mentions
        with monkeypatch.context() as m:
            m.setattr(words, "mentions", lambda *a: (asked.append(a), mentions(*a))[1])
            QUERIES[query](spark, f"{tmp_path}/{n}")
        return held(lambda: mentions(*asked[-1]))

    (few, _), (many, given) = of(150), of(600)
    assert sum(n for n, _ in given) == 600 * 2 and many < 1.3 * few


def test_contexts_of_a_large_batch_are_sent_in_pieces(spark, held):
    names = spark.createDataFrame([(1, n) for n in NAMES], "novel long, name string")
    mb, given = held(lambda: words.contexts(stories(spark), ["doc"], "text", names, "novel"))
    assert sum(n for n, _ in given) == 400 * 20 and max(x for _, x in given) < 3e6 and mb < 20


def test_only_runs_that_hold_names_are_cut_for_contexts(spark, held, monkeypatch):
    rng, letters = random.Random(5), "ab é1 ,沈砚长风来了青石城"
    known = Words.of([("沈砚", 9.0), ("长风", 5.0), ("来了", 3.0), ("石城", 2.0), ("青石城", 4.0)])
    names = {s: sorted({"".join(rng.choice(letters.replace(" ", "")) for _ in range(rng.choice([1, 2, 3]))) for _ in range(8)}) for s in range(80)}
    docs = [(i, i % 80, "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 40, 80])))) for i in range(800)]
    want = set()
    for i, s, t in docs:
        known.add(s, [(n, None) for n in names[s]])
        cut = known.tokens([t], s)[0]
        want |= {(i, n, words.around(t, [at for w, at in cut if w == n], 3, 6, 30)) for n in names[s] if n in t}
    known.own.clear()
    seen, cut = [], Words.cut
    monkeypatch.setattr(Words, "tokens", lambda *_: pytest.fail("whole texts are cut into words"))
    monkeypatch.setattr(Words, "cut", lambda self, runs, scope=None: (seen.extend(runs), cut(self, runs, scope))[1])
    listed = spark.createDataFrame([(s, n) for s in names for n in names[s]], "novel long, name string")
    got = []
    monkeypatch.setattr(words, "told", lambda b, keys, rows, name, context: got.extend(zip(b.column("doc").take(pa.array(rows, pa.int64())).to_pylist(), name.to_pylist(), context.to_pylist())) or b)
    held(lambda: words.contexts(spark.createDataFrame(docs, "doc long, novel long, text string"), ["doc"], "text", listed, "novel", known, 3, 6, 30))
    assert set(got) == want and len(got) == len(want) and seen and len(known.own) <= words.REMEMBERED


def test_what_contexts_hold_does_not_grow_with_the_batch(spark, held):
    names = spark.createDataFrame([(1, n) for n in NAMES], "novel long, name string")
    (few, _), (many, given) = (held(lambda n=n: words.contexts(stories(spark, n), ["doc"], "text", names, "novel")) for n in (150, 600))
    assert sum(n for n, _ in given) == 600 * 20 and many < 1.3 * few


def test_the_query_on_scenes_holds_a_slice_of_them(spark, held, monkeypatch, tmp_path):
    def of(n):
        rows = [(i, i * 7 % 11, ["view", "click", "purchase", "signup", "error"][i * 13 % 17 % 5]) for i in range(64 * n)]
        spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/{n}/events.parquet")
        asked, contexts = [], words.contexts
        with monkeypatch.context() as m:
            m.setattr(words, "contexts", lambda *a: (asked.append(a), contexts(*a))[1])
            QUERIES["scene_contexts"](spark, f"{tmp_path}/{n}")
        return held(lambda: contexts(*asked[-1]))

    (few, least), (many, given) = of(1500), of(4500)
    assert sum(n for n, _ in given) > 2.9 * sum(n for n, _ in least) > 0 and many < 1.3 * few


def test_words_of_a_large_batch_are_cut_in_slices(spark, held):
    known = Words.of([("沈砚", 9.0), ("长风", 5.0), ("来了", 3.0)])
    docs = spark.createDataFrame([(i, 1, "沈砚长风，来了。" * 400) for i in range(400)], "doc long, novel long, text string")
    own = spark.createDataFrame([(1, "风来", None)], "novel long, word string, freq long")
    mb, given = held(lambda: words.token_lists(docs, ["doc"], "text", known, "novel", own))
    assert sum(n for n, _ in given) == 400 and len(given) > 2 and mb < 60


def test_pairs_of_a_large_batch_are_summed_on_the_way(spark, held, monkeypatch):
    monkeypatch.setattr(graph, "AT_ONCE", 1 << 13)
    lists = words.token_lists(stories(spark), ["novel", "doc"], "text")
    named = spark.createDataFrame([(1, n[:-1]) for n in NAMES] + [(1, w) for w in ("name", "x", "of", "the", "words", "sea")], "novel long, name string")
    mb, given = held(lambda: graph.entity_pairs(lists, "novel", "doc", "tokens", named))
    assert given and mb < 40


def test_postings_of_a_large_batch_come_in_slices():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(20_000)) for _ in range(200)]
    b = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts)], names=["key", "text"])
    tracemalloc.start()
    n = sum(int(pc.sum(x.column("keys").value_lengths()).as_py()) for x in text_index._postings(iter([b])))
    mb = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert n == sum(len({t[i : i + 3] for i in range(len(t) - 2)}) for t in texts) and mb < 25


def test_a_model_gets_its_texts_in_batches_of_the_whole(spark, held):
    mb, given = held(lambda: model_calls.embed(stories(spark), "doc", "text"))
    assert sum(n for n, _ in given) == 400 and max(n for n, _ in given) == 32 and mb < 4
