import math
import random

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fabula.functions import json as J
from fabula.functions import text as T


def one(spark, column, **values):
    names = list(values)
    kinds = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'long'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x if names else None


def test_windows_cover_the_text(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 60))), 1 + i % 9) for i in range(80)]
    for size, overlap in ((8, 0), (8, 3), (5, 9), (0, 0), (7, -2)):
        s = size or 800
        step = s - (overlap if 0 <= overlap < s else 0)
        got = spark.createDataFrame(rows, "i long, t string, k long").select("t", T.windows(F.col("t"), size, overlap).alias("w")).collect()
        for r in got:
            n = math.ceil(max(0, len(r.t) - s) / step) + 1
            want = [(k * step, r.t[k * step : k * step + s].strip()) for k in range(n)]
            assert [(w.start, w.content) for w in r.w] == [x for x in want if x[1]]


def test_chapters_round_trip(spark):
    text = "preface\n第一章 起\n甲乙\n\n丙\n## Chapter 2\nbody two\n　第３章\n\n在第五回中说\n第四回 " + "长" * 50 + "\ntail"
    got = one(spark, T.split_chapters(F.col("t")), t=text)
    assert [(c.title, c.content) for c in got] == [("第一章 起", "甲乙\n\n丙"), ("Chapter 2", "body two"), ("第３章", "在第五回中说\n第四回 " + "长" * 50 + "\ntail")]
    assert all(text[c.char_start : c.char_end].strip() == c.content for c in got)
    alone = one(spark, T.split_chapters(F.col("t")), t="no heading here")
    assert [(c.title, c.content) for c in alone] == [(None, "no heading here")]


def test_trimming_and_names(spark):
    assert one(spark, T.strip(F.col("t")), t="\x1c 　a b\n\x1f") == "a b"
    assert one(spark, T.safe_name(F.col("t")), t="a/b c_1-é") == "abc_1-é"
    assert one(spark, T.safe_name(F.col("t")), t="///") == "untitled"
    assert one(spark, T.clean_title(F.col("t"), F.col("n")), t=" \n", n=3) == "第3章"
    assert one(spark, T.occurrences(F.col("t"), F.lit("aa")), t="aaaaa") == 2
    assert one(spark, T.token_estimate(F.col("t")), t="abc") == 1
    assert one(spark, T.cut_at_sentence(F.col("t"), 10), t="abcdef. ghijkl") == "abcdef. "
    assert one(spark, T.bigram_jaccard(F.col("t"), F.lit("abcd")), t="abcd") == 1.0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8))
def test_variance(spark, values):
    got = spark.createDataFrame([(values,)], "v array<int>").select(T.variance(F.col("v")).alias("x")).first().x
    mean = sum(values) / len(values)
    assert abs(got - sum((v - mean) ** 2 for v in values) / len(values)) < 1e-9


def test_json_rescue(spark):
    assert one(spark, J.outermost(F.col("t")), t='Sure:\n```json\n[{"a": 1}, {"a": 2}]\n```') == '[{"a": 1}, {"a": 2}]'
    assert one(spark, J.outermost(F.col("t")), t="nothing") is None
    assert one(spark, J.rescued_array(F.col("t"), "k"), t='{"k": ["a", "b\\"c"], "z": [') == ["a", 'b\\"c']
    assert one(spark, J.clean_list(F.split("t", ",")), t="a, ,b") == ["a", "b"]


def test_marks_times_and_cuts(spark):
    marks = lambda t: [tuple(c) for c in one(spark, T.mark_chapters(F.col("t")), t=t)]
    assert marks("前言第一章 甲第2回乙") == [("第一章", " 甲"), ("第2回", "乙")] and marks("无题") == [("", "无题")]
    assert one(spark, T.time_expressions(F.col("t")), t="公元前221年7月1日，上古时期，永乐年间，19世纪") == ["公元前221年7月1日", "上古", "永乐年间", "19世纪"]
    assert one(spark, T.sentence_lengths(F.col("t")), t="a b。 　 。cd\n!") == [2, 2]
    assert one(spark, T.dialogue_density(F.col("t")), t="“ab」cd") == 4 / 6
    for text, limit in (("一二。三四五六", 5), ("一二三四。五六", 6), ("一二三，四五六七", 6), ("一二三\n\n五六七", 7), ("abcdefgh", 5), ("ab", 5)):
        head = text[:limit]
        want = text if len(text) <= limit else next((text[: c + 1] for m in T.CUT_AFTER if (c := text.rfind(m, 0, limit)) > limit * 0.5), head)
        assert one(spark, T.cut_at_sentence(F.col("t"), limit), t=text) == want


def test_many_chapters_in_one_text(spark):
    body = "\n".join(f"Chapter {i}\nline {i}\n" for i in range(1500))
    got = one(spark, T.split_chapters(F.col("t")), t="before\n" + body)
    text = "before\n" + body
    assert len(got) == 1500 and all(c.content == f"line {i}" and text[c.char_start : c.char_end].strip() == c.content for i, c in enumerate(got))


def test_chapter_chunks_are_counted_as_in_the_sql(spark, tmp_path):
    from fabula.plans.queries import ORACLES, QUERIES

    texts = [None, "", " \t\r\n\f", " " * 2000, "a", "a" * 1500 + "  ", "a" * 1501, "a" * 1500 + " " * 1500 + "b", "a" * 1500 + "\xa0", "a" * 1500 + "\x0b", "　", "\x1c" * 1501, "a" * 1499 + "  ", "山🦆" * 800, "a" * 3000]
    rows = [(i, t, "src1") for i, t in enumerate(texts)] + [(4, "a", "src1"), (4, "b" * 4000, "src2"), (None, "a", "src1"), (77, "a", None)]
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, source varchar, lang varchar, n_chars bigint)")
    c.executemany("insert into documents values (?, ?, ?, 'en', 1)", rows)
    c.execute(f"copy documents to '{tmp_path}/documents.parquet'")
    want = c.sql(f"select doc_id, n_chunks from ({ORACLES['chunk_chapter_mode']})").fetchall()
    got = QUERIES["chunk_chapter_mode"](spark, str(tmp_path)).select("doc_id", "n_chunks").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
