"""Tables that streams keep: interrupted and repeated batches change nothing."""

import pytest
from pyspark.sql import functions as F

from fabula import storage
from fabula.operators import dashboard, model_calls
from fabula.streaming.keyed import KeyedTable

ROWS = "task long, seq long, status string, note string, tokens long, extra string"


def plain(rows):
    out = {}
    for task, seq, status, note, tokens, _ in sorted(rows, key=lambda r: r[1]):
        own = out.setdefault(task, [seq, None, None, 0])
        own[0] = max(own[0], seq)
        own[1], own[2] = status if status is not None else own[1], note if note is not None else own[2]
        own[3] += tokens or 0
    return sorted((k, *v) for k, v in out.items())


def rows_of(n):
    return [(i % 7, i, ["new", "run", None, "end"][i * 5 % 4], f"n{i}" if i % 3 == 0 else None, i % 5 or None, "x") for i in range(n)]


def table(spark, path):
    return KeyedTable(spark, str(path / "table"), ["task"], "seq", ["status", "note"], ["tokens"])


def log(spark, path, rows, files):
    for i in range(files):
        spark.createDataFrame(rows[i::files], ROWS).coalesce(1).write.mode("append").parquet(str(path / "log"))
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(path / "log"))


def test_a_stream_keeps_what_a_batch_would_compute(spark, tmp_path):
    rows, t = rows_of(60), table(spark, tmp_path)
    assert t.read() is None
    t.follow(log(spark, tmp_path, rows, 4), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(map(tuple, t.read().collect())) == plain(rows)
    for _ in range(2):  # compacted, and once more; batches that come again are older than the base
        t.compact()
        t.write(spark.createDataFrame(rows[1::4], ROWS), 1)
        assert sorted(map(tuple, t.read().collect())) == plain(rows)
    more = [(1, 99, "late", None, 3, ""), (50, 5, None, None, None, "")]
    t.write(spark.createDataFrame(more, ROWS), 4)
    t.compact()
    assert sorted(map(tuple, t.read().collect())) == plain(rows + more)
    assert storage.names(spark, str(tmp_path / "table/bases")) == ["4"] and storage.names(spark, str(tmp_path / "table/batch")) == ["4"]


@pytest.mark.parametrize("between", ["the batch and the ledger", "the ledger and the commit"])
def test_a_stream_that_is_killed_in_a_batch_goes_on_without_counting_it_twice(spark, tmp_path, monkeypatch, between):
    rows, t, killed = rows_of(60), table(spark, tmp_path), []
    source = log(spark, tmp_path, rows, 4)
    real = storage.mark

    def dies(session, path):
        if path.endswith("/ledger/1") and not killed:
            killed.append(path)
            if between == "the ledger and the commit":
                real(session, path)
            raise RuntimeError("killed")
        real(session, path)

    monkeypatch.setattr(storage, "mark", dies)
    with pytest.raises(Exception, match="killed"):
        t.follow(source, str(tmp_path / "checkpoint")).awaitTermination()
    seen = t.read().agg(F.sum("tokens")).first()[0]
    t.follow(source, str(tmp_path / "checkpoint")).awaitTermination()
    assert killed and sorted(map(tuple, t.read().collect())) == plain(rows) and seen < sum(r[4] or 0 for r in rows)


def usage_of(n):
    from datetime import datetime, timedelta
    from decimal import Decimal

    return [(i % 3, i % 4, "chat" if i % 2 else "embed", ["a", "b", None][i % 3], i, i % 11, Decimal(i) / 1000, datetime(2024, 1, 1) + timedelta(hours=17 * i % 900)) for i in range(n)]


USAGE = "owner_id long, config_id long, task_type string, model string, tokens_in long, tokens_out long, cost decimal(18,6), created_at timestamp"


@pytest.mark.parametrize("cuts", [[0, 90], [0, 1, 2, 50, 90], [0, 0, 90, 90]])
def test_any_split_into_deltas_gives_what_a_full_scan_gives(spark, tmp_path, cuts):
    rows = usage_of(90)
    order = sorted(rows, key=lambda r: r[4] * 7919 % 97)  # late rows in every delta
    rollup = dashboard.UsageRollup(spark, str(tmp_path))
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        rollup.add(spark.createDataFrame(order[a:b], USAGE), i)
        rollup.add(spark.createDataFrame(rows[:5], USAGE), i)  # the number is taken
        if i == 1:
            rollup.table.compact()
    rollup.add(spark.createDataFrame([r for r in rows if r[4] % 9 == 0], USAGE), 99, sign=-1)
    left = [r for r in rows if r[4] % 9]
    for keys, at in ((["owner_id"], [0]), (["config_id", "model"], [1, 3]), (["task_type", "owner_id", "model"], [2, 0, 3])):
        want = {}
        for r in left:
            own = want.setdefault(tuple(r[i] for i in at), [0, 0, 0, 0])
            for i, x in enumerate((r[4], r[5], 1, r[6])):
                own[i] += x
        got = {tuple(r)[: len(keys)]: list(tuple(r)[len(keys) :]) for r in rollup.totals(*keys).collect()}
        assert got == {k: [a, b, c, float(d)] for k, (a, b, c, d) in want.items()}


def test_a_run_that_was_stopped_asks_no_model_twice(spark, tmp_path):
    items = spark.createDataFrame([(i, f"p{i}") for i in range(9)], "k long, prompt string").coalesce(1)
    asked = tmp_path / "asked"

    def model(r):
        def reply(texts):
            with asked.open("a") as f:
                f.writelines(f"{r} {t}\n" for t in texts)
            if r == 1 and not (tmp_path / "mended").exists():
                raise RuntimeError("stopped")
            return ["good" if int(t[1:]) % 3 == r else "bad" for t in texts]

        return reply

    rounds = storage.Rounds(spark, str(tmp_path / "run"))
    loop = lambda: model_calls.retry_loop(items, "k", "prompt", model, lambda df: df.withColumn("ok", F.col("reply") == "good"), rounds.stored)
    with pytest.raises(Exception, match="stopped"):
        loop()
    assert rounds.done() == ["0"]
    (tmp_path / "mended").touch()
    got = {r.k: (r.attempts, r.needs_review) for r in loop().collect()}
    assert got == {i: (i % 3 + 1, False) for i in range(9)}
    again = {r.k: (r.attempts, r.needs_review) for r in loop().collect()}
    calls = asked.read_text().splitlines()
    assert again == got and sum(c.startswith("0 ") for c in calls) == 9 and sum(c.startswith("2 ") for c in calls) == 3
    rounds.finish()
    assert rounds.done() == []


def test_summaries_are_reduced_within_the_budget_and_in_order(spark, tmp_path):
    prompts = tmp_path / "prompts"
    prompts.mkdir()

    def model(texts):
        for t in texts:
            (prompts / str(abs(hash(t)))).write_text(t)
        return [t.replace("\n", "")[:60] for t in texts]

    rows = [(k, i, chr(97 + i % 26) * (5 + i % 4)) for k, n in ((1, 40), (2, 1), (3, 2), (4, 9)) for i in range(n)]
    parts = spark.createDataFrame(rows, "k long, at long, text string")
    got = {r.k: r for r in model_calls.reduce_by_budget(parts, "k", "at", "text", storage.Rounds(spark, str(tmp_path / "r")).stored, model, budget=130).collect()}
    whole = {k: "".join(t for x, _, t in sorted(rows) if x == k) for k in got}
    assert {k: r.parts for k, r in got.items()} == {1: 40, 2: 1, 3: 2, 4: 9} and got[2].rounds == 0 and got[1].rounds >= 2
    assert all(got[k].summary == whole[k] for k in (2, 3, 4)) and all(len(p.read_text()) <= 130 for p in prompts.iterdir())
    with pytest.raises(ValueError, match="budget"):
        model_calls.reduce_by_budget(parts, "k", "at", "text", storage.Rounds(spark, str(tmp_path / "s")).stored, model, budget=10)


def test_the_query_of_summaries_equals_plain_rounds(spark):
    from fabula.plans.queries import _chunks
    from fabula.fixtures import Views
    from fabula.plans.story import QUERIES

    stub = lambda t: t.replace("\n", " ").split(".")[0][:60]
    docs = {}
    for r in _chunks(Views(spark, "/root/testdata/sf0.001"), 800, 0).collect():
        docs.setdefault(r.doc_id, []).append((r.piece_no, r.content))
    left = {d: [stub(t) for _, t in sorted(x)] for d, x in docs.items()}
    done = {d: (len(docs[d]), 0, x[0]) for d, x in left.items() if len(x) == 1}
    number = 0
    while rest := {d: x for d, x in left.items() if len(x) > 1}:
        number += 1
        most = max(len(s) + 1 for x in rest.values() for s in x)
        left = {}
        for d, x in rest.items():
            groups, begin = {}, 0
            for s in x:
                groups.setdefault(begin // (400 - most), []).append(s)
                begin += len(s) + 1
            left[d] = [stub("\n".join(g)) for _, g in sorted(groups.items())]
        done |= {d: (len(docs[d]), number, x[0]) for d, x in left.items() if len(x) == 1}
    assert {r.doc_id: (r.parts, r.rounds, r.summary) for r in QUERIES["summary_by_budget"](spark, "/root/testdata/sf0.001").collect()} == done
