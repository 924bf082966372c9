"""Plain twins of the queries that have no SQL: every row is computed again, document by document."""

import hashlib

import pytest

from fabula.fixtures import Views
from fabula.plans.queries import _chunks
from fabula.plans.story import QUERIES

DIR = "/root/testdata/sf0.001"


def stub(text):
    return text.replace("\n", " ").split(".")[0][:60]


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in Views(spark, DIR).document().select("doc_id", "text").collect()}


def plain_cuts(text, size, overlap, ends):
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            marks = [i for i, c in enumerate(text[start:end]) if c in ends]
            if marks and marks[-1] > size // 2:
                end = start + marks[-1] + 1
        else:
            end = len(text)
        out.append((start, end))
        if end == len(text):
            return out
        start = max(end - overlap, start + 1)
    return out


@pytest.mark.parametrize("name, size, overlap, ends", [("sentence_chunks", 1000, 100, ".\n"), ("sentence_pieces", 600, 0, "\n.!?")])
def test_cuts_at_sentences(spark, texts, name, size, overlap, ends):
    want = sorted((d, a, b) for d, t in texts.items() for a, b in plain_cuts(t or "", size, overlap, ends))
    assert sorted((r.doc_id, r.start, r.stop) for r in QUERIES[name](spark, DIR).collect()) == want


def test_summaries_of_chunks(spark):
    docs = {}
    for r in _chunks(Views(spark, DIR), 800, 0).collect():
        docs.setdefault(r.doc_id, []).append((r.piece_no, stub(r.content)))
    want = {}
    for d, x in docs.items():
        parts = [s for _, s in sorted(x)]
        want[d] = (len(parts), parts[0] if len(parts) == 1 else stub("\n".join(parts)))
    assert {r.doc_id: (r.parts, r.summary) for r in QUERIES["map_reduce_summary"](spark, DIR).collect()} == want


def test_embeddings_are_those_of_the_whole_texts(spark, texts):
    want = {d: sum(b / 255 for b in hashlib.sha256((t or "").encode()).digest()[:8]) for d, t in texts.items()}
    got = {r.doc_id: (r.dim, r.total) for r in QUERIES["embed_batches"](spark, DIR).collect()}
    assert got.keys() == want.keys() and all(n == 8 and abs(x - want[d]) < 1e-9 for d, (n, x) in got.items())
