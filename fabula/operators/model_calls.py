"""Steps backed by a model, behind a callable that maps texts to texts; the stub needs no network."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.operators import tables

Model = Callable[[list[str]], list[str]]


def stub_summary(texts: list[str]) -> list[str]:
    """The first sentence, at most 60 characters: a pure function of the input."""
    return [t.replace("\n", " ").split(".")[0][:60] for t in texts]


def stub_embedding(texts: list[str], dim: int = 8) -> list[list[float]]:
    return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:dim]] for t in texts]


def call_model(df: DataFrame, model: Model, text: str, out: str = "reply", keep: list[str] | None = None, batch: int = 32) -> DataFrame:
    """`keep` columns and the model's reply to `text`, in batches of `batch` texts within each task."""
    keep = keep or [c for c in df.columns if c != text]
    source = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                yield pa.RecordBatch.from_arrays([*part.select(keep).columns, pa.array(model(part.column("_text").to_pylist()), pa.string())], names=[*keep, out])

    return source.mapInArrow(run, source.select(*keep).schema.add(out, "string"))


def embed(df: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]] = stub_embedding) -> DataFrame:
    """(key, embedding array<double>, dim)."""
    replies = call_model(df, lambda ts: [json.dumps(v) for v in model(ts)], text, "reply", [key])
    return replies.select(key, F.from_json("reply", "array<double>").alias("embedding")).withColumn("dim", F.size("embedding").cast("long"))


def summarise(chunks: DataFrame, key: str, order: str, text: str, model: Model = stub_summary) -> DataFrame:
    """(key, parts, summary): each chunk summarised; several summaries of a key are joined in order and summarised again."""
    mapped = call_model(chunks, model, text, "summary", [key, order])
    joined = mapped.groupBy(key).agg(F.count("*").alias("parts"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "summary"))), lambda x: x["summary"]), "\n").alias("joined"))
    alone, several = joined.where("parts = 1").select(key, "parts", F.col("joined").alias("summary")), joined.where("parts > 1")
    return alone.unionByName(call_model(several, model, "joined", "summary", [key, "parts"]))


def reduce_by_budget(parts: DataFrame, key: str, order: str, text: str, stored: Callable[[DataFrame, str], DataFrame], model: Model = stub_summary, budget: int = 4000, size: Callable[[Column], Column] = F.length) -> DataFrame:
    """(key, parts, rounds, summary): each part summarised, then neighbours together, as many as `budget` holds, until a key has one.

    `order` is a whole number that is unique in its key. In each round running sizes are cut at multiples of the budget
    less the largest part, so that what begins within one stretch fits one prompt; a line end between two parts counts.
    Parts keep their order. `stored` writes each round, so that no model is asked twice. A part that takes more than half
    of the budget, or rounds that no longer make fewer parts, raise an error: no prompt exceeds the budget.
    """
    total = parts.groupBy(key).agg(F.count(F.lit(1)).alias("parts"))
    left, done, number = stored(call_model(parts, model, text, "summary", [key, order]).select(key, F.col(order).cast("long").alias("at"), "summary"), "map"), None, 0
    while True:
        several = left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        one = left.join(several.where("n = 1").select(key), key).select(key, "summary", F.lit(number).alias("rounds"))
        done = one if done is None else done.unionByName(one)
        rest = left.join(several.where("n > 1").select(key), key).withColumn("size", size(F.col("summary")) + 1)
        now = rest.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("most")).first()
        if not now.n:
            return done.join(total, key).select(key, "parts", "rounds", "summary")
        if number and now.n >= before or 2 * now.most > budget:
            raise ValueError(f"summaries of up to {now.most} do not fit a budget of {budget} in twos")
        before, number = now.n, number + 1
        packed = tables.running(rest, [key], "at", F.col("size"), "begin").withColumn("at", F.floor(F.col("begin") / (budget - now.most)))
        prompts = packed.groupBy(key, "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "summary"))), lambda x: x["summary"]), "\n").alias("prompt"))
        left = stored(call_model(prompts, model, "prompt", "summary", [key, "at"]), f"reduce-{number}")


def retry_loop(items: DataFrame, key: str, prompt: str, model: Callable[[int], Model], valid: Callable[[DataFrame], DataFrame], store: Callable[[DataFrame, int], DataFrame], rounds: int = 3) -> DataFrame:
    """Calls the model until `valid` (adds a boolean `ok`) passes, `rounds` times at most.

    Each round's replies are stored by `store`, so that no round is computed twice; what is left over stays with
    needs_review set. `model(round)` gives that round's callable.
    """
    left, done = items, None
    for r in range(rounds):
        judged = store(valid(call_model(left, model(r), prompt, "reply", [key, prompt])).withColumn("attempts", F.lit(r + 1)), r)
        passed = judged.where("ok") if r < rounds - 1 else judged
        passed = passed.select(key, "reply", "attempts", (~F.col("ok")).alias("needs_review"))
        done = passed if done is None else done.unionByName(passed)
        left = items.join(judged.where("not ok").select(key), key, "left_semi")
    return done


def placed(asked: DataFrame, replies: DataFrame, batch: list[str], number: str) -> DataFrame:
    """`asked` (batch, number, place) with `by_index`, the reply that names its number, and `by_place`, the one at its place in the batch.

    `replies` are (batch, place, named, reply); a reply that names nothing counts by its place alone.
    """
    named = replies.where("named is not null").groupBy(*batch, F.col("named").alias(number)).agg(F.min_by("reply", "place").alias("by_index"))
    return asked.join(named, [*batch, number], "left").join(replies.select(*batch, "place", F.col("reply").alias("by_place")), [*batch, "place"], "left")


def still_missing(rejected: DataFrame, passed: DataFrame, rejected_again: DataFrame, key: str) -> DataFrame:
    """What was rejected and has since neither passed nor been rejected again: the retry lost it."""
    return rejected.join(passed.select(key), key, "left_anti").join(rejected_again.select(key), key, "left_anti")


def fresh(memo: DataFrame, now, ttl: str) -> DataFrame:
    """The latest entry (key, reply, created_at) of each key that is not older than `ttl` before `now` (a column)."""
    live = memo.where(F.col("created_at") >= now - F.expr(f"interval {ttl}"))
    return live.groupBy("key").agg(F.max_by("reply", "created_at").alias("reply"), F.max("created_at").alias("created_at"))


def without_prefix(memo: DataFrame, prefix: str) -> DataFrame:
    """The memo without the keys that begin with `prefix`."""
    return memo.where(~F.startswith("key", F.lit(prefix)))


def memoised(items: DataFrame, memo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of `items` by the digest of their text in `memo` (digest, reply)."""
    keyed = items.withColumn("digest", F.sha2("text", 256))
    return keyed.join(memo, "digest"), keyed.join(memo.select("digest"), "digest", "left_anti")
