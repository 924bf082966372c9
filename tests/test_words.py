"""Words, mentions, contexts and co-occurrences against plain versions."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from fabula import fixtures
from fabula.functions import excerpts, segment
from fabula.operators import graph, words
from fabula.plans.story import QUERIES

DIR = "/root/testdata/sf0.001"


def plain_cut(run, freq, total, own=()):
    """A dynamic program from the end, a character at a time; of equal sums the longer word."""
    own = dict(own)
    best, step = [0.0] * (len(run) + 1), [1] * len(run)
    for at in range(len(run) - 1, -1, -1):
        choices = []
        for n in range(1, len(run) - at + 1):
            w = run[at : at + n]
            weight = own.get(w, math.log(freq[w] / total) if w in freq else -math.log(total) if n == 1 else None)
            if weight is not None:
                choices.append((weight + best[at + n], n))
        best[at], step[at] = max(choices)
    out, at = [], 0
    while at < len(run):
        out.append(run[at : at + step[at]])
        at += step[at]
    return out, best[0]


def plain_context(text, places, before=200, after=400, limit=4000):
    """The rule, hit by hit."""
    if not places:
        return text[:limit]
    n, last, pieces, total = len(text), -1, [], 0
    for part in range(4):
        low, high = int(part * n / 4), n if part == 3 else int((part + 1) * n / 4)
        own = 0
        for h in [h for h in places if low <= h < high]:
            a, b = max(0, h - before), min(n, h + after)
            if a > last and (own == 0 or own < limit // 4):
                pieces.append(text[a:b])
                last, own = b, own + b - a
        total += own
        if total >= limit:
            break
    out = "\n……\n".join(pieces)
    if len(out) > limit:
        ends = [out.rfind(e, 0, limit) for e in "。！？"]
        out = out[: next((e for e in ends if e >= 0), limit)]
    return out


def test_runs_are_cut_as_by_a_plain_program():
    rng = random.Random(1)
    word = lambda most: "".join(rng.choice("甲乙丙丁戊己") for _ in range(rng.randint(1, most)))
    for _ in range(40):
        freq = {word(4): rng.randint(1, 50) for _ in range(rng.randint(0, 40))}
        own = {word(5): rng.randint(1, 500) for _ in range(5)}
        known = segment.Words.of(freq.items())
        known.add("n", own.items())
        runs = [word(30) for _ in range(40)] + ["", "甲", "其", "𠀀甲"]
        assert list(known.cut(runs)) == [plain_cut(r, freq, known.total)[0] for r in runs]
        weights = {w: math.log(f / known.total) for w, f in own.items()}
        assert list(known.cut(runs, "n")) == [plain_cut(r, freq, known.total, weights)[0] for r in runs]
    long = word(1) * 40_000
    assert "".join(next(segment.Words.of([("甲乙", 2)]).cut([long]))) == long


def test_own_words_win_over_their_parts_and_stay_in_their_scope():
    known = segment.Words.of([("安静", 100), ("来了", 50), ("说", 9), ("请安静", 30)])
    known.add(1, [("说安静来", None)])
    assert list(known.cut(["他说安静来了", "请安静"])) == [["他", "说", "安静", "来了"], ["请安静"]]
    assert list(known.cut(["他说安静来了"], 1)) == [["他", "说", "安静", "来了"]] and list(known.cut(["说安静来"], 1)) == [["说安静来"]]
    assert known.tokens(["Anna 他说,安静abc来了 x2"]) == [[("Anna", 0), ("他", 5), ("说", 6), ("安静", 8), ("abc", 10), ("来了", 13), ("x", 16)]]


def test_tokens_of_mixed_rows(spark):
    rows = [(1, "a", "Anna MET 安静来了, again"), (2, "b", None), (3, "a", ""), (4, "b", "only Latin, été"), (5, "b", "顾长风来了"), (6, "a", "顾长风来了"), (7, None, "顾长风来了")]
    docs = spark.createDataFrame(rows, "id long, novel string, text string").withColumn("token", F.lit(1))
    own = spark.createDataFrame([("a", "顾长风", None), ("b", "风来了", 500.0)], "novel string, word string, freq double")
    known = words.load(spark.createDataFrame([("安静", 9), ("来了", 5), (None, 1)], "word string, freq long"))
    got = {}
    for r in sorted(words.tokens(docs, ["id"], "text", known, "novel", own).collect()):
        got.setdefault(r.id, []).append(r.token)
    assert got == {1: ["anna", "met", "安静", "来了", "again"], 4: ["only", "latin", "été"], 5: ["顾", "长", "风来了"], 6: ["顾长风", "来了"], 7: ["顾", "长", "风", "来了"]}
    try:
        words.load(spark.createDataFrame([("安静", 9), ("来了", 5)], "word string, freq long"), most=1)
        raise AssertionError
    except ValueError:
        pass


def test_excerpts_equal_the_plain_rule():
    rng = random.Random(8)
    for _ in range(400):
        n = rng.randint(0, 900)
        text = "".join(rng.choice("ab。！？ ") if rng.random() < 0.1 else rng.choice("xyz") for _ in range(n))
        hits = sorted(rng.sample(range(n), rng.randint(0, min(n, 30)))) if n else []
        before, after, limit = rng.choice([(5, 9, 60), (20, 40, 200), (200, 400, 4000), (3, 0, 20)])
        assert excerpts.around(text, hits, before, after, limit) == plain_context(text, hits, before, after, limit)


def test_pair_windows_equal_a_plain_scan():
    rng = random.Random(9)
    for _ in range(400):
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 200)))
        a, b, limit = rng.choice(["a", "ab", "aa"]), rng.choice(["b", "ba", "bb", "aab"]), rng.choice([10, 60, 3000])
        places = [[m.start() for m in re.finditer(f"(?={x})", text)] for x in (a, b)]
        if not all(places):
            continue
        windows = [text[max(0, m.start() - 4) : m.start() + 7] for m in re.finditer(a, text)]
        both, total = [], 0
        for w in windows:
            if b in w and total < limit:
                both.append(w)
                total += len(w)
        assert excerpts.around_both(text, a, places[0], b, places[1], 4, 7, limit) == ("\n……\n".join(both)[:limit] if both else windows[0])


def test_mentions_equal_a_search_for_each_name(spark):
    rng = random.Random(10)
    text = lambda: "".join(rng.choice("abc安静") for _ in range(rng.randint(0, 80)))
    docs = [(i, rng.choice([1, 2, 3, None]), text() if i % 9 else None) for i in range(120)]
    names = [(n, "".join(rng.choice("abc安静") for _ in range(rng.randint(1, 4)))) for n in (1, 2) for _ in range(12)] + [(1, ""), (2, None), (None, "a")]
    df, known = spark.createDataFrame(docs, "id long, novel long, text string"), spark.createDataFrame(names, "novel long, name string")
    want = sorted({(i, n, t.count(n), t.index(n)) for i, s, t in docs for z, n in names if t and n and s is not None and s == z and n in t})
    assert sorted(map(tuple, words.mentions(df, ["id"], "text", known, "novel").collect())) == want
    few = words.with_names(df, known, "novel", most=3)
    assert few.count() == words.with_names(df, known, "novel").count() == sum(s in (1, 2) for _, s, _ in docs)


def test_contexts_of_the_queries_equal_plain_versions(spark):
    v = fixtures.Views(spark, DIR)
    freq = {w: f for w, f, _ in fixtures.DICTIONARY}
    total = sum(freq.values())
    people = {}
    for r in v.scene_token().where("flag = 'nr'").select("novel_id", "token").distinct().collect():
        people.setdefault(r.novel_id, set()).add(r.token)
    want = set()
    for r in v.scene().collect():
        names = people.get(r.novel_id, set())
        own = {n: plain_cut(n, freq, total)[1] + 1e-9 * (1 + abs(plain_cut(n, freq, total)[1])) for n in names}
        at, places = 0, {n: [] for n in names if n in r.text}
        for stretch in re.findall(f"[{segment.HAN}]+|[^{segment.HAN}]", r.text):
            for w in plain_cut(stretch, freq, total, own)[0] if re.match(f"[{segment.HAN}]", stretch) else [stretch]:
                if w in places:
                    places[w].append(at)
                at += len(w)
        want |= {(r.novel_id, r.doc_id, n, plain_context(r.text, p)) for n, p in places.items()}
    assert {tuple(r) for r in QUERIES["scene_contexts"](spark, DIR).collect()} == want and len(want) > 20


def test_name_and_pair_contexts_of_documents_equal_plain_versions(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    v = fixtures.Views(spark, DIR)
    cast, pairs, want, both = {}, {}, set(), set()
    for r in v.cast().collect():
        cast.setdefault(r.novel_id, []).append(r.name)
    for r in v.relation().where("weight > 60").collect():
        pairs.setdefault(r.novel_id, []).append((r.source, r.target))
    for r in v.chapter().select("novel_id", "doc_id", F.lower("content").alias("t")).collect():
        for n in cast.get(r.novel_id, []):
            if n in r.t:
                places = [m.start() for m in re.finditer(rf"(?<![^\W\d_]){re.escape(n)}(?![^\W\d_])", r.t)]
                want.add((r.doc_id, n, sha(plain_context(r.t, places))))
        for a, b in pairs.get(r.novel_id, []):
            if a in r.t and b in r.t:
                windows = [r.t[max(0, m.start() - 150) : m.start() + 300] for m in re.finditer(re.escape(a), r.t)]
                held, size = [], 0
                for w in windows:
                    if b in w and size < 3000:
                        held.append(w)
                        size += len(w)
                both.add((r.doc_id, a, b, sha("\n……\n".join(held)[:3000] if held else windows[0])))
    assert {tuple(r) for r in QUERIES["name_contexts"](spark, DIR).collect()} == want
    assert {tuple(r) for r in QUERIES["pair_contexts"](spark, DIR).collect()} == both and both


def test_running_counts_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(12)
    lists = [(rng.choice([1, 2, None]), i, [rng.choice("abcdefg安静") for _ in range(rng.choice([0, 1, 2, 50, 400]))]) for i in range(30)]
    entities = [(n, x) for n in (1, 2) for x in "abcd安"[: 3 + n]]
    docs = spark.createDataFrame(lists, "novel long, doc long, tokens array<string>")
    known = spark.createDataFrame(entities, "novel long, name string")
    want = {}
    for novel, _, tokens in lists:
        own = [t for t in tokens if (novel, t) in entities]
        for i, a in enumerate(own):
            for b in own[max(0, i - 7) : i]:
                if a != b:
                    key = (novel, min(a, b), max(a, b))
                    want[key] = want.get(key, 0) + 1
    for at_once, most in ((1 << 21, 100), (8, 100), (1 << 21, 2)):
        monkeypatch.setattr(graph, "AT_ONCE", at_once)
        got = graph.entity_pairs(docs, "novel", "doc", "tokens", known, reach=7, most=most)
        assert {(r.novel, r.source, r.target): r.weight for r in got.collect()} == want
    assert graph.entity_pairs(docs, "novel", "doc", "tokens", known.limit(0)).count() == 0
    assert not list(graph.frame_counts(np.zeros(0, np.int64), np.array([0]), 5))
