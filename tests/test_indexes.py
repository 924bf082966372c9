"""Kept indexes against plain scans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabula import storage
from fabula.operators import text_index, vector_index


def like(text, pattern):
    import re

    out, literal = "", False
    for c in pattern:
        if literal or c not in "%_\\":
            out, literal = out + re.escape(c), False
        elif c == "\\":
            literal = True
        else:
            out += "." if c == "_" else ".*"
    return re.fullmatch(out, text, re.S | re.I) is not None


def test_patterns_find_what_a_scan_finds(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice(["ab", "Ba", "c ", "%", "_", "é日", "\n", "𠀀x"]) for _ in range(rng.randint(0, 60)))
    now = {i: text() if i % 11 else None for i in range(200)}
    schema, root = "doc_id long, text string", str(tmp_path / "index")
    text_index.add(spark.createDataFrame([*now.items(), (None, "abab")], schema), root, 0)
    change = {i: text() if i % 3 else None for i in range(0, 260, 4)}
    text_index.add(spark.createDataFrame(list(change.items()), schema), root, 1)
    text_index.add(spark.createDataFrame([(0, "never")], schema), root, 1)  # the batch is there
    now |= change
    patterns = ["%abab%", "%ABAB%c %", "abba%", "%\\%ab%", "%ab_ab%", "%\\_\\_ab%", "ab", "%", "%日é%", "%𠀀x𠀀%", "%never%", "%a%b%c%", "%bac ab%", "%é日é日%ab%"]
    for few in (text_index.FEW, 1):
        monkeypatch.setattr(text_index, "FEW", few)
        for p in patterns:
            want = sorted((k, t) for k, t in now.items() if t is not None and like(t, p))
            assert sorted(map(tuple, text_index.search(spark, root, p).collect())) == want, p
    text_index.compact(spark, root, str(tmp_path / "small"))
    assert sorted(map(tuple, text_index.search(spark, str(tmp_path / "small"), "%abab%").collect())) == sorted((k, t) for k, t in now.items() if t is not None and like(t, "%abab%"))


def test_a_search_reads_the_files_of_its_own_grams(spark, tmp_path, capsys):
    root = str(tmp_path / "index")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text_index.add(docs, root, 0)
    text_index.candidates(spark, root, "%worth%").explain("formatted")
    plan = capsys.readouterr().out
    assert "part" in plan.split("PartitionFilters")[1].split("\n")[0] and "gram" in plan.split("PushedFilters")[1].split("\n")[0] and "texts" not in plan
    want = {r.doc_id for r in docs.where(F.col("text").ilike("%worth%")).collect()}
    assert {r.key for r in text_index.search(spark, root, "%worth%").collect()} == want
    assert {r.key for r in text_index.candidates(spark, root, "%worth%").collect()} >= want


def test_a_batch_that_was_interrupted_is_written_again(spark, tmp_path):
    root, schema = str(tmp_path / "index"), "doc_id long, text string"
    text_index.add(spark.createDataFrame([(1, "first words"), (2, "other words")], schema), root, 0)
    text_index.add(spark.createDataFrame([(1, "second words"), (3, "words")], schema), root, 1)
    storage.remove(spark, f"{root}/batches/1")  # as if it had ended before
    find = lambda: sorted(map(tuple, text_index.search(spark, root, "%words").collect()))
    assert find() == [(1, "first words"), (2, "other words")]
    text_index.add(spark.createDataFrame([(1, "third words")], schema), root, 1)
    assert find() == [(1, "third words"), (2, "other words")]


def plain_nearest(rows, asked, k):
    out = []
    for i, q in asked:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, q)), j) for j, v in rows if j != i)
        out += [(i, j, n + 1) for n, (_, j) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("n, cells, k", [(400, None, 5), (400, 1, 3), (7, 3, 20), (300, 300, 1)])
def test_cells_give_the_exact_neighbours(spark, tmp_path, n, cells, k):
    rng = np.random.default_rng(n + k)
    groups = rng.normal(0, 20, (8, 6))
    x = np.round(groups[rng.integers(0, 8, n)] + rng.normal(0, 1, (n, 6)), 1)
    x[: n // 4] = x[0]  # copies: ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(None, rows[0][1]), (n, None), (n + 1, [1.0]), (n + 2, [None] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    vector_index.build(df, str(tmp_path), cells=cells)
    got = vector_index.search(spark, str(tmp_path), df.where("vec_id % 3 = 0 or vec_id is null"), k).collect()
    assert sorted((r.query_id, r.vec_id, r.rank) for r in got) == plain_nearest(rows, [r for r in rows if r[0] % 3 == 0], k)
    if cells is None:
        used = {r.query_id: r.cells for r in got}
        assert sum(used.values()) < 0.5 * len(used) * spark.read.parquet(f"{tmp_path}/cells").count()
    assert vector_index.search(spark, str(tmp_path), df.limit(0), k).count() == 0
