"""Groups that a third of the rows or more hold: results as by brute force, and few entries where a group meets."""

import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest

from fabula.llm import line_dedup, recompression, suffix_index
from fabula.llm.firsts import SPANS, Firsts, Wide
from fabula.llm.repeats import match_families, send_families

SLOTS = list(range(7))


def tasks_of(rows, n_tasks, at_once=20):
    """Batches of rows, dealt to tasks in ranges."""
    size = -(-len(rows) // n_tasks)
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        yield [pa.RecordBatch.from_arrays([pa.array([d for d, _ in cut], pa.int64()), pa.array([t for _, t in cut], pa.large_string())], names=["doc_id", "text"]) for cut in (part[j : j + at_once] for j in range(0, len(part), at_once))]


def dealt(batches):
    """Batches by their slot, as a shuffle does it."""
    out = defaultdict(list)
    for b in batches:
        for i, slot in enumerate(b.column("slot").to_pylist()):
            out[slot].append(b.slice(i, 1))
    return out


def most_of_one_key(slots, plane):
    return max(Counter(np.concatenate([np.frombuffer(x, np.uint64) for rows in slots.values() for b in rows for x in b.column(plane).to_pylist()]).tolist()).values())


def hot_rows(n, seed=5, sep=" "):
    """Every second text holds one passage, and every text one short phrase amid words of its own."""
    rng = random.Random(seed)
    own = lambda k: sep.join(f"w{rng.randint(0, 10**6)}" for _ in range(k))
    passage, phrase = own(30), "a phrase that every text of them holds somewhere"
    rows = [(i, sep.join([own(rng.randint(1, 20)), phrase, own(20), *([passage] if i % 2 else []), own(3)])) for i in range(n)]
    rng.shuffle(rows)
    return rows


def test_a_key_is_settled_where_it_is_met_again():
    rng = np.random.default_rng(3)
    for same_doc in (True, False):
        firsts, sent, gone, seen = Firsts(same_doc, remembered=3), set(), set(), []
        for _ in range(20):
            keys, docs, starts = rng.integers(0, 9, 40).astype(np.uint64), rng.integers(0, 50, 40), rng.integers(0, 3, 40).astype(np.uint32)
            again, of, at = firsts.judge(keys, keys, docs, starts)
            for k, d, s, g, o, a in zip(keys.tolist(), docs.tolist(), starts.tolist(), again.tolist(), of.tolist(), at.tolist(), strict=True):
                seen.append((k, d, s))
                (gone if g else sent).add((k, d, s))
                assert not g or ((o, a) < (d, s) and (same_doc or o < d))
        first = {k: min((d, s) for x, d, s in seen if x == k) for k in range(9)}
        assert all((k, *first[k]) in sent for k in first)  # the first of a key is always sent
        assert len(gone) > len(sent)
    assert not len(firsts.judge(*(np.zeros(0, x) for x in (np.uint64, np.uint64, np.int64, np.uint32)))[0])


def test_a_seed_of_many_spans_is_sent_a_few_times():
    wide = Wide(spans=2)
    seeds, spans = np.array([1, 1, 1, 2, 1, 1], np.uint64), np.array([5, 6, 7, 5, 5, 8], np.uint64)
    assert wide.beyond(seeds, spans).tolist() == [False, False, False, False, True, True]
    assert wide.beyond(seeds, spans).tolist() == [True, True, True, False, True, True]
    assert not wide.beyond(np.array([2, 2, 2], np.uint64), np.array([5, 5, 5], np.uint64)).any()  # one span alone is never enough
    assert not len(wide.beyond(seeds[:0], spans[:0])) and not len(Wide().beyond(seeds[:0], spans[:0]))


@pytest.mark.parametrize("scheme", [recompression.SCHEME, suffix_index.SCHEME])
def test_a_slot_gets_few_families_of_one_seed(scheme):
    rows, n_tasks = hot_rows(600), 3
    slots = dealt(b for task in tasks_of(rows, n_tasks) for b in send_families(scheme, SLOTS)(iter(task)))
    # documents are in no order, so a key's earliest place falls a few times before it is settled
    assert most_of_one_key(slots, "seeds") <= n_tasks * (SPANS + 20)
    found = [b for rows in slots.values() for b in match_families(scheme.same_doc, SLOTS)(iter(rows))]
    assert sum(len(x) // 8 for b in found for x in b.column("docs").to_pylist()) > 300


def test_a_slot_gets_few_of_one_chunk_of_lines():
    rows, n_tasks = hot_rows(600, sep="\n"), 3
    slots = dealt(b for task in tasks_of(rows, n_tasks) for b in line_dedup.send_chunks(SLOTS)(iter(task)))
    assert most_of_one_key(slots, "high") <= n_tasks * 20


def test_results_with_hot_groups(spark):
    rows, lines = hot_rows(300), hot_rows(300, sep="\n")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.remove_repeats(docs).collect()} == brute.repeated_words(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_index.remove_repeats(docs).collect()} == brute.repeated_bytes(rows)
    got = {r.doc_id: r.kept for r in line_dedup.dedup_lines(spark.createDataFrame(lines, "doc_id long, text string").repartition(5)).collect()}
    assert got == {d: x[-1] for d, x in brute.repeated_lines(lines).items()}
