import base64
import math
import random

import brute
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from fabula.llm import byte_bpe, components, decontaminate, language_id, line_dedup, near_dup, recompression, suffix_index, token_count, topk, toxicity


def test_byte_bpe_equals_the_library(spark, docs, rows, nothing):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.encode_documents(docs, path, P.PATTERN, keep_ids=True).collect()}
    for d, t in rows:
        assert got[d].ids == library.encode_ordinary(t or "")
        assert got[d].n_tokens == len(got[d].ids) and got[d].decoded_sha256 == brute.sha((t or "").encode())
        assert got[d].ids_sha256 == brute.sha(",".join(map(str, got[d].ids)).encode())
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, path, P.PATTERN, keep_ids=True), path)
    assert {r.doc_id: r.text for r in back.collect()} == {d: t or "" for d, t in rows}
    assert byte_bpe.encode_documents(nothing, path, P.PATTERN).count() == 0


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "x" * 3000, "Ab" * 900, " " * 700 + "é", "\U0001f600" * 300, "á‍\r\n\r\n  z", "12345678901234567890"])
def test_byte_bpe_of_odd_texts(text):
    import tiktoken

    ranks = byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    bpe = byte_bpe.ByteBpe(ranks, P.PATTERN)
    assert bpe.encode(text) == tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
    assert bpe.decode(bpe.encode(text)).decode() == text


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts_and_cache(spark, docs, rows, nothing, tmp_path, name):
    count = token_count.load_counter(P.path(name))
    cache = str(tmp_path / "cache")
    want = sorted((d, len((t or "").encode()), count([t or ""])[0], count([t or ""])[0] > 100) for d, t in rows)
    assert sorted(map(tuple, token_count.count_tokens(docs, P.path(name), cache, limit=100).collect())) == want
    size = spark.read.parquet(cache).count()
    assert size == len({t or "" for _, t in rows})
    again = token_count.count_tokens(docs.union(docs.limit(3)), P.path(name), cache, limit=100)
    assert again.count() == len(rows) + 3 and spark.read.parquet(cache).count() == size  # nothing is encoded twice
    assert token_count.count_tokens(nothing, P.path(name)).count() == 0


ITEMS = [(1, "alpha Beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item"), (3, "solo"), (4, None), (5, "..."), (6, "gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi")]


def test_decontamination(spark, nothing):
    rng = random.Random(3)
    vocabulary = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi short item solo x y".split()
    rows = [(1, ITEMS[0][1]), (2, "x, ALPHA beta-gamma delta.epsilon zeta eta theta iota kappa lambda nu"), (3, None), (4, ""), (5, "solo"), (6, "a short\nitem"), (7, "é solo é")]
    for i in range(60):
        at = rng.randint(0, 6)
        run = vocabulary[at : at + rng.randint(1, 13)]
        rows.append((10 + i, " ".join([*rng.choices(vocabulary, k=rng.randint(0, 6)), *run, *rng.choices(vocabulary, k=rng.randint(0, 6))])))
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(brute.decontaminate(rows, ITEMS))
    assert sorted(map(tuple, decontaminate.report(docs, items).collect())) == want
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    several = decontaminate.contamination(base, items, automaton_bytes=20)  # an automaton for each item or two
    assert sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in several.collect()) == [x[:4] for x in want]
    left = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items).collect()}
    assert left[3] is None and left[4] == "" and 1 not in left and left[7] == "é  é"
    assert decontaminate.report(nothing, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(docs, items.limit(0)).collect())


def test_near_duplicates(spark, docs, rows, nothing):
    for n in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, n).collect()}
        assert got == brute.near_duplicates(rows, n)
    kept = near_dup.keep_one(docs, 5)
    want = brute.near_duplicates(rows, 5)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, (_, c) in want.items() if d == c}
    assert near_dup.near_duplicates(nothing).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(odd, 2).collect()), key=repr) == [(1, 1, True), (1, 1, True), (2, 2, True), (None, None, True)]


def test_signature_join_is_complete():
    """Any two signatures within the distance share a key."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**16, (1, near_dup.VALUES), dtype=np.uint16)
    for _ in range(200):
        y = x.copy()
        at = rng.choice(near_dup.VALUES, near_dup.DISTANCE, replace=False)
        y[0, at] ^= np.uint16(1)
        a, b = near_dup.chunk_keys(x)[0], near_dup.chunk_keys(y)[0]
        met = np.flatnonzero(a == b)
        assert len(met) and near_dup.first_key(x == y)[0] == met[0]


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)]
    parent = {x: x for l in links for x in l}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in l and l[0] != l[1] for l in links)}


def test_repeated_bytes(spark, docs, rows, nothing):
    want = brute.repeated_bytes(rows)
    for batches in (1, 2, 5):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_index.remove_repeats(docs, batches).collect()}
        assert got == want
    assert suffix_index.remove_repeats(nothing).count() == 0


def test_levels_merge(spark, docs, monkeypatch):
    index = suffix_index.SuffixIndex(spark)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = []
    for i in range(5):
        index.add(base.where(F.col("doc_id") % 5 == i))
        sizes.append([l.batches for l in index.levels])
        for level in index.levels:  # a merged level is sorted, too
            for r in spark.table(level.table).collect():
                assert (np.diff(np.frombuffer(r.seeds, np.uint64).astype(object)) >= 0).all()
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]
    index.drop()
    merges, store = [], suffix_index.SuffixIndex._store
    monkeypatch.setattr(suffix_index.SuffixIndex, "_store", lambda self, arrays: merges.append(1) or store(self, arrays))
    suffix_index.remove_repeats(docs)  # with the query's own number of batches: four arrays, and one merge of two
    assert len(merges) == suffix_index.BATCHES + 1


def test_repeated_words(spark, docs, rows, nothing):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.remove_repeats(docs).collect()}
    assert got == brute.repeated_words(rows)
    assert recompression.remove_repeats(nothing).count() == 0
    odd = spark.createDataFrame([(None, "a " * 20), (3, "a " * 20), (3, "a " * 20), (4, "a " * 13 + "b")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_removed) for r in recompression.remove_repeats(odd).collect()), key=repr) == [(3, 0), (3, 0), (4, 13), (None, 0)]


def test_top_k(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(10)]) for i in range(300)] + [(300 + i, [0.5] * 10) for i in range(60)]
    vectors += [(400, None), (450, [1.0] * 9 + [None]), (500, [math.nan] * 10), (550, [math.inf] * 10)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    rounded = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute.top_k(rounded, lambda i: i % 50 == 0)
    asked = F.col("vec_id") % 50 == 0
    assert sorted(map(tuple, topk.top_k(df, asked).collect())) == want
    assert sorted(map(tuple, topk.top_k(df.union(df.limit(40)), asked, queries_at_once=3, lists=3).collect())) == want
    assert topk.top_k(df.limit(0), asked).count() == 0 and topk.top_k(df, asked, k=1000).count() == len({q for q, *_ in want}) * 359


def test_line_chunks(spark, nothing):
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice("red green blue black white".split()) for _ in range(6))
    block = [line() for _ in range(30)]
    rows = [(1, "\n".join(block)), (2, "\n".join([line(), line(), *block, line()])), (3, None), (4, ""), (5, "\n\n"), (6, "\n".join(block[7:])), (7, "only one line of text that is long enough to be a chunk")]
    rows += [(8, rows[6][1]), (9, "\r\n".join(block)), (10, "\n".join(block) + "\n" + "\n".join(block))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    import pyarrow as pa

    from fabula.llm.textkit import text_bytes

    seen = set()
    for d, t in sorted(rows):
        raw, off = text_bytes(pa.array([t], pa.string()))
        data, at, kept = raw.tobytes(), 0, []
        for s, e, n in zip(*(x.tolist() for x in line_dedup.chunks(raw, off)[1:])):
            if n >= line_dedup.LEAST_LINES and e - s >= line_dedup.LEAST_BYTES:
                if data[s:e] in seen:
                    kept.append(data[at:s])
                    at = e + (data[e : e + 1] == b"\n")
                seen.add(data[s:e])
        assert got[d].kept == b"".join([*kept, data[at:]]).decode(), d
    assert got[2].lines_removed >= 20 and got[6].lines_removed >= 15  # borders resist the shift
    assert got[8].chunks_removed == 0 and line_dedup.dedup_lines(nothing).count() == 0


def test_every_repeated_passage_of_lines_goes(spark):
    rng = random.Random(16)
    line = lambda: " ".join(rng.choice("red green blue black white é日".split()) for _ in range(rng.choice((0, 1, 1, 2, 4, 8))))
    own = lambda d, n: [f"{d} {line()}" if rng.random() < 0.8 else "" for _ in range(n)]
    rows = [(d, "\n".join(own(d, rng.randint(2, 14)))) for d in range(60)]
    for d in range(60, 160):
        source = rng.choice(rows)[1].split("\n")
        n, i = rng.randint(2, 10), rng.randint(0, len(source))
        rows.append((d, "\n".join([*own(d, rng.randint(0, 3)), *source[i : i + n], *own(d, rng.randint(0, 3))])))
    copies = list(range(1000, 1060))
    rows += [(d, rng.choice(rows[:60])[1] + rng.choice(("", "\n"))) for d in copies]
    rows += [(2000, "\n".join(["the same line of at least forty bytes, again"] * 5)), (2001, None), (2002, ""), (2003, "a\nb\na\nb")]
    rng.shuffle(rows)
    want = brute.repeated_lines(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.chunks_removed, r.lines_removed, r.kept) for r in line_dedup.dedup_lines(table).collect()}
    assert got == want
    assert {r.doc_id: r.text for r in line_dedup.without_repeats(table).collect()} == {d: None if t is None else want[d][3] for d, t in rows}
    texts = dict(rows)
    long = [d for d in copies if len(texts[d].strip("\n").encode()) >= 40 and len(texts[d].split()) and len([x for x in texts[d].split("\n") if x]) >= 2]
    assert len(long) > 30 and all(got[d][2] == got[d][0] for d in long)  # nothing of an exact copy stays
    assert sum(x[2] for d, x in got.items() if 60 <= d < 160) > 100


def labelled(spark, n=1200):
    rng = random.Random(8)
    mild = "the of and a stone river walks under green light with paper".split()
    bad = ["dolt", "cretin", "blazzok", "blazzup", "blazzim"]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(mild, k=rng.randint(5, 60))
        toxic = i % 5 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            w.insert(rng.randint(0, len(w)), rng.choice(bad))
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(toxic)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string"), labels, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark, docs, nothing):
    rows, table, labels, marks = labelled(spark)
    got = {r.doc_id: r for r in toxicity.score_documents(table, marks).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(got[d].predicted, y) for d, y in labels if got[d].held_out]
    assert len(held) > 200 and sum(p == y for p, y in held) >= 0.98 * len(held)
    kept = toxicity.reject_toxic(table, marks)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} <= {d for d, y in labels} and kept.count() < 1000
    none = toxicity.score_documents(docs, marks.limit(0))  # no labels: the function words alone
    assert none.count() == docs.count() and toxicity.score_documents(nothing, marks).count() == 0


def test_toxicity_grammar_tags():
    read = lambda s: [a | b for a, b in zip(toxicity.FORWARD.read(s), toxicity.BACKWARD.read(s[::-1])[::-1])]
    o, i, t, target, no, said, intent = toxicity.SYMBOLS
    aimed, said_of, meant = toxicity.TAG_TARGET, toxicity.TAG_SAID, toxicity.TAG_MEANT
    assert read([target, o, i]) == [0, 0, aimed | said_of] and read([target, o, o, o, o, i])[-1] == aimed
    assert read([no, o, i]) == [0, 0, toxicity.TAG_NEGATED] and read([no, o, o, o, i])[-1] == 0
    assert read([i, o, said]) == [toxicity.TAG_REPORTED, 0, 0]
    assert read([intent, t, target])[1] == aimed | meant and read([intent, i])[1] == 0 and read([target, t])[1] == aimed
    assert read([said, no, t, target])[2] == aimed | toxicity.TAG_NEGATED | toxicity.TAG_REPORTED
    to = [toxicity.sum_of(x, tag) for x, tag in ((t, 0), (t, meant), (t, aimed), (t, aimed | meant), (i, 0), (i, said_of | aimed), (i, 2 | aimed), (i, 4 | 2))]
    assert to == [None, None, toxicity.AIMED, toxicity.DIRECT, toxicity.PLAIN, toxicity.DIRECT, toxicity.NEGATED, toxicity.REPORTED]


def test_toxicity_sums_equal_a_plain_reading():
    import re

    import pyarrow as pa

    from fabula.llm.textkit import text_bytes

    rng = random.Random(12)
    g = toxicity.Grammar({b"dolt": 0.5, b"blaz*": 0.25})
    functions = {w: s for s, ws in toxicity.FUNCTION_WORDS.items() for w in ws.split()}
    vocabulary = [*rng.sample(sorted(functions), 12), "kill", "you", "not", "said", "dolt", "blazzo", "blaz", "river", "stone", "green"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", ". ", ", ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, ""]
    want = np.zeros((len(texts), 5))
    for r, text in enumerate(texts):
        for clause in re.split(r"[.,;:!?\n]", (text or "").lower()):
            words = clause.split()
            kind = [toxicity.INSULT if w == "dolt" or w.startswith("blaz") and len(w) > 4 else functions.get(w, 0) for w in words]
            near = lambda k, s, n: s in kind[max(0, k - n) : k]
            for k, x in enumerate(kind):
                if x in (toxicity.INSULT, toxicity.THREAT):
                    rest = kind[:k] + kind[k + 1 :]
                    tags = (toxicity.TARGET in rest) + 2 * near(k, toxicity.NEGATION, 3) + 4 * (toxicity.REPORT in rest)
                    tags |= 8 * (x == toxicity.INSULT and near(k, toxicity.TARGET, 4)) | 16 * (x == toxicity.THREAT and near(k, toxicity.INTENT, 4))
                    if (to := toxicity.sum_of(x, tags)) is not None:
                        want[r, to] += 0.8 if x == toxicity.THREAT else 0.5 if words[k] == "dolt" else 0.25
    got, _ = g.sums(*text_bytes(pa.array(texts, pa.string())))
    assert np.allclose(got, want) and got.sum() > 50


def test_language_id(spark, docs, nothing):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language_id.identify(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == table.count() and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !", "en"), (4, "the river", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(odd).collect()} in ({1: "und", 2: "und", 3: "und", 4: "en"}, {i: "und" for i in range(1, 5)})
    assert language_id.identify(nothing).count() == 0 and all(r.lang_pred == "und" for r in language_id.identify(docs).collect())
