import random
import re

import brute
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fabula.llm import byte_bpe, decontaminate, language_id, line_dedup, near_dup, recompression, suffix_index, textkit, token_count, topk, toxicity


def thue_morse(n, flip=0):
    """Words of 2**n letters that collide, with their complements, under every polynomial modulo 2**64."""
    return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(1 << n))


A, B = thue_morse(11), thue_morse(11, 1)


def test_words_of_one_pattern_are_different_words(spark):
    head = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([*head, A])), (2, " ".join([*head, B])), (3, " ".join([*head, A]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.remove_repeats(docs).collect()} == brute.repeated_words(rows)
    for n, texts in ((2, [f"p {A}", f"p {B}", f"p {A}"]), (5, [f"{A} a b c d e f", f"{B} a b c d e f"])):
        own = list(enumerate(texts))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(own, "doc_id long, text string"), n).collect()}
        assert got == brute.near_duplicates(own, n)
    items = [(1, " ".join([*head[:9], A]))]
    got = decontaminate.report(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute.decontaminate(rows, items)) and [r.n_hit for r in got if r.doc_id == 2] == [0]
    rows = [(1, A), (2, B), (3, "x" + A[:300] + "y"), (4, B + A)]
    got = suffix_index.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.repeated_bytes(rows)
    two = f"{A}\n{A}\n"
    rows = [(1, two), (2, two.translate(str.maketrans("ab", "ba"))), (3, two)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_lines, r.chunks_removed, r.lines_removed, r.kept) for r in got} == brute.repeated_lines(rows)


def test_words_that_share_a_hash_are_compared_by_bytes(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = ["a b c d e f g", "a b c d e f h"], ["a b c d e f g", "a b c d e f g"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([3, 4]), *map(pa.array, texts)], names=["a", "b", "text_a", "text_b"])
    for few in (False, True):
        if few:
            monkeypatch.setattr(textkit.Words, "hashes", lambda self, which=0: (self.ends - self.starts).astype(np.uint64))
        out = pa.Table.from_batches(near_dup.verify(2, 80)(iter([batch])))
        assert out.column("a").to_pylist() == [1]


def test_bitmaps_leave_no_link_out():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(300):
        x = rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64)
        y = np.concatenate([x[: rng.integers(0, len(x) + 1)], rng.integers(0, 2**63, rng.integers(0, 60), dtype=np.uint64)])
        x, y = np.unique(x), np.unique(y)
        if len(y):
            both = len(np.intersect1d(x, y))
            fit = near_dup.may_link([near_dup.bitmap(x)], [near_dup.bitmap(y)], np.array([len(x)]), np.array([len(y)]), 80)[0]
            assert fit or 100 * both < 80 * (len(x) + len(y) - both)


def test_a_large_group_of_near_copies_is_linked_as_by_brute_force(spark, monkeypatch):
    """Blocks and stars are made small, so that keys have several blocks, and minorities in them."""
    for name, size in (("BLOCK", 16), ("STAR", 4), ("HUB", 8), ("AT_ONCE", 64)):
        monkeypatch.setattr(near_dup, name, size)
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(60)], []
    for d in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 400)}"
        rows.append((d, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2).collect()}
    assert got == brute.near_duplicates(rows, 2) and len(set(got.values())) > 10


LONG = "the river and the stone " * 4000


def by_row(df, column="doc_id"):
    return sorted(map(repr, df.collect()))


OPERATORS = {
    "op1": lambda docs, spark: toxicity.score_documents(docs, spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")),
    "op2": lambda docs, spark: byte_bpe.encode_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN),
    "op3": lambda docs, spark: decontaminate.report(docs, spark.createDataFrame([(1, "the river and"), (None, "stone"), (2, None)], "item_id long, text string")),
    "op4": lambda docs, spark: token_count.count_tokens(docs, P.path("piece_bpe_32k.model")),
    "op5": lambda docs, spark: line_dedup.dedup_lines(docs),
    "op6": lambda docs, spark: suffix_index.remove_repeats(docs),
    "op8": lambda docs, spark: language_id.identify(docs),
    "op9": lambda docs, spark: near_dup.near_duplicates(docs, 2),
    "op10": lambda docs, spark: recompression.remove_repeats(docs),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    """Null ids, repeated rows, null, empty and very long texts, and other columns with the names that operators use."""
    rows = [(None, "the river and the stone", "en"), (None, None, None), (1, None, "en"), (2, "", None), (3, LONG, "en"), (3, LONG, "en"), (4, "the river and the stone", "de"), (4, "the river and the stone", "de")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clash = plain.select("*", *[F.lit("x").alias(c) for c in ("key", "row", "hits", "items", "rows", "starts", "n_words", "component", "id", "score", "toxic", "slot", "kept", "sig")])
    got = OPERATORS[name](plain, spark)
    assert got.count() == len(rows) and {r.doc_id for r in got.collect()} == {None, 1, 2, 3, 4}
    assert by_row(got) == by_row(OPERATORS[name](clash, spark))
    twice = [r for r in got.collect() if r.doc_id in (3, 4)]
    assert len(set(map(repr, twice))) == 2  # repeated rows give repeated results


def test_odd_vectors(spark):
    rows = [(None, [1.0]), (0, [1.0, 2.0]), (50, [3.0]), (50, [3.0]), (7, []), (9, [1e6, 1e6])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("class_id", F.lit(1)).withColumn("list", F.lit(2)), F.col("vec_id") % 50 == 0)
    assert sorted((r.query_id, r.vec_id) for r in got.collect()) == [(0, 7), (0, 9), (0, 50), (50, 0), (50, 7), (50, 9)]


def plain_cut(text, items, window=10):
    """Text without the runs of hit words; None if more than half of the words are hit."""
    raw = text.encode()
    at = [(m.start(), m.end()) for m in brute.ALNUM.finditer(raw.translate(brute.UPPER))]
    words = [raw.translate(brute.UPPER)[s:e] for s, e in at]
    wanted = set()
    for _, item in items:
        w = brute.ALNUM.findall((item or "").encode().translate(brute.UPPER))
        n = min(window, len(w))
        wanted |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    hit = [False] * len(words)
    for n in {len(k) for k in wanted}:
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in wanted:
                hit[i : i + n] = [True] * n
    if sum(hit) > 0.5 * len(hit):
        return None
    out, last = [], 0
    for i, h in enumerate(hit):
        if h:
            if not (i and hit[i - 1]):
                out.append(raw[last : at[i][0]])
            last = at[i][1]
    return b"".join([*out, raw[last:]]).decode()


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import tiktoken

    rng = random.Random(31)
    mild = "the of and a stone river walks under green light with paper hill cloud tree path over again never quite".split()
    line = lambda: " ".join(rng.choice(mild) + str(rng.randint(0, 60)) for _ in range(rng.randint(4, 9)))
    rows = [(i, "\n".join(line() for _ in range(rng.randint(2, 9))), "en", None) for i in range(160)]
    toxic = {i: rows[i][1].replace(" ", f" {rng.choice(['dolt', 'cretin', 'blazzok'])} ", 2) + " you dolt" for i in range(0, 160, 5)}
    rows = [(i, toxic.get(i, t), a, b) for i, t, a, b in rows]
    passage = "\n".join(line() for _ in range(4))
    item = " ".join(line() for _ in range(4))
    rows += [(200 + i, f"{line()}\n{passage}\n{line()}", "en", "src") for i in range(5)]
    rows += [(300 + i, rows[1 + i][1] + f" end{i}", "en", "src") for i in range(3)] + [(310 + i, rows[6][1], "en", "src") for i in range(3)]
    rows += [(400, f"{' '.join(line() for _ in range(5))} {item} {line()}", "en", None), (401, item, "en", None), (402, None, "en", None), (403, "", None, None)]
    words = rows[6][1].split()
    rows += [(500, " ".join(words[:40]), "en", None), (501, " ".join([*words[:39], "other"]), "en", None)]
    schema = "doc_id long, text string, lang string, key string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i in toxic)) for i in range(160)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    texts = {d: t for d, t, *_ in rows if d not in toxic}
    kept = brute.repeated_lines(list(texts.items()))
    texts = {d: None if t is None else kept[d][3] for d, t in texts.items()}
    near = brute.near_duplicates(list(texts.items()), 5)
    texts = {d: t for d, t in texts.items() if near[d][1] == d}
    texts = {d: t if t is None else plain_cut(t, [(1, item)]) for d, t in texts.items() if t is None or plain_cut(t, [(1, item)]) is not None}
    ranks = byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {d: (len(ids := library.encode_ordinary(t or "")), brute.sha(",".join(map(str, ids)).encode()), brute.sha((t or "").encode())) for d, t in texts.items()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    assert 401 not in got and 400 in got and 402 in got and len(got) < len(rows) - len(toxic)
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(empty / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
    assert re.fullmatch(r"[0-9a-f]{64}", got[400][1])


def test_accuracy_of_languages_equals_a_plain_nearest_centroid(spark):
    """The prediction is the centroid of greatest cosine, computed here row by row."""
    import numpy as np
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    for r in docs.limit(40).collect():
        tf = np.zeros(language_id.DIMENSIONS)
        low = [c if 97 <= c <= 122 or c >= 128 else 32 for c in r.text.encode().translate(brute.UPPER)]
        for n in language_id.GRAMS:
            for i in range(len(low) - n + 1):
                gram = int.from_bytes(bytes(low[i : i + n]), "big") + (n << 24) & 0xFFFFFFFF
                tf[(gram * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
        x = np.sqrt(tf) * model.idf
        near = model.centroids @ (x / np.linalg.norm(x))
        assert got[r.doc_id][0] == model.languages[model.owner[near.argmax()]] and abs(got[r.doc_id][1] - near.max()) < 1e-4
    assert textkit.text_bytes(pa.array([None, "a"], pa.string()))[1].tolist() == [0, 0, 1]
