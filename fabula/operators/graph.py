"""Entities, their co-occurrence, and the graph that a front end draws."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions.slices import lengths, slices
from fabula.operators import tables

#: Entities of all scopes together that are broadcast; see `entity_pairs`.
MOST_ENTITIES = 200_000
#: Cells of running counts, and pairs that wait to be summed, that are held at once; tokens or mentions that are looked at at once.
AT_ONCE, MENTIONS = 1 << 20, 1 << 18


def tagged(words: DataFrame, dictionary: DataFrame, scope: list[str], word: str = "token", default: str = "x") -> DataFrame:
    """`words` with the flag that the dictionary (scope, word, flag) gives them, `default` where it has none.

    A dictionary with a scope, such as a novel's own words, holds within it only; nothing is shared between scopes.
    """
    named = dictionary.withColumnRenamed("word", word).groupBy(*scope, word).agg(F.min("flag").alias("flag"))
    return words.join(named, [*scope, word], "left").withColumn("flag", F.coalesce("flag", F.lit(default)))


def frame_counts(numbers: np.ndarray, starts: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each part (numbers from one of `starts` to the next) its distinct numbers and, of each two, how often one has the other among the `reach` before it.

    The counts in the frame are differences of running counts: what has come so far less what had come `reach` earlier.
    """
    for i, (s, e) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        if e - s < 2:
            continue
        own, at = np.unique(numbers[s:e], return_inverse=True)
        total, n, k = np.zeros((len(own), len(own)), np.int64), e - s, len(own)
        block = max(reach, AT_ONCE // k)
        for low in range(0, n, block):
            first, high = max(0, low - reach), min(n, low + block)
            come = np.zeros((high - first + 1, k), np.int32)
            come[np.arange(1, high - first + 1), at[first:high]] = 1
            np.cumsum(come, axis=0, out=come)
            here = np.arange(low, high)
            inside = come[here - first] - come[np.maximum(here - reach, 0) - first]
            order = np.argsort(at[low:high], kind="stable")
            mine, begin = np.unique(at[low:high][order], return_index=True)
            total[mine] += np.add.reduceat(inside[order], begin, axis=0)
        yield i, np.stack([np.repeat(own, k), np.tile(own, k), total.ravel()])


def summed(parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], kinds: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scope, smaller number, larger number, weight) of all parts together, summed by scope; scopes are numbers, too.

    `parts` come as (scope of each part, their starts, numbers). Pairs are summed whenever AT_ONCE of them wait.
    """
    keys, weights, waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def total() -> tuple[np.ndarray, np.ndarray]:
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        return found, np.bincount(at, np.concatenate(weights), len(found)).astype(np.int64)

    for code, starts, numbers in parts:
        for i, (a, b, w) in frame_counts(numbers, starts, reach):
            met = (w > 0) & (a != b)
            keys.append((code[i] * kinds + np.minimum(a, b)[met]) * kinds + np.maximum(a, b)[met])
            weights.append(w[met])
            waiting += len(weights[-1])
            if waiting >= AT_ONCE:
                found, weight = total()
                keys, weights, waiting = [found], [weight], 0
    found, weight = total()
    return found // (kinds * kinds), found // kinds % kinds, found % kinds, weight


def cooccurrence(mentions: DataFrame, scope: list[str], part: str, pos: str, name: str, reach: int = 80) -> DataFrame:
    """(scope, source, target, weight): unordered pairs of different names (or numbers of names) at most `reach` mentions apart in a part.

    A part's mentions are brought together; its pairs are summed by running counts before they are sent anywhere.
    """
    parts = mentions.groupBy(*scope, part).agg(F.sort_array(F.collect_list(F.struct(pos, name))).alias("m")).select(*scope, F.transform("m", lambda m: m[name]).alias("m"))
    ends = parts.select(F.col("m").alias("x")).schema["x"].dataType.elementType
    schema = parts.select(*scope).schema.add("source", ends).add("target", ends).add("weight", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, lengths(whole.column("m")), MENTIONS)):
            lists = b.column("m")
            named = lists.flatten().dictionary_encode()
            # numbered in the names' order, so that the smaller name is the source
            rank = pc.rank(named.dictionary, tiebreaker="dense").to_numpy().astype(np.int64) - 1
            words = named.dictionary.take(pc.array_sort_indices(named.dictionary))
            numbers = rank[named.indices.to_numpy(zero_copy_only=False)] if len(named) else np.zeros(0, np.int64)
            starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            of: dict[tuple, int] = {}
            code = np.array([of.setdefault(s, len(of)) for s in zip(*[b.column(s).to_pylist() for s in scope], strict=True)], np.int64)
            scopes, low, high, weight = summed([(code, starts, numbers)], max(len(words), 1), reach)
            by = [pa.array([x[i] for x in of], b.column(s).type).take(pa.array(scopes)) for i, s in enumerate(scope)]
            yield pa.RecordBatch.from_arrays([*by, words.take(pa.array(low)), words.take(pa.array(high)), pa.array(weight)], names=[*scope, "source", "target", "weight"])

    return parts.mapInArrow(count, schema).groupBy(*scope, "source", "target").agg(F.sum("weight").alias("weight"))


def entity_pairs(docs: DataFrame, scope: str, doc: str, token_list: str, entities: DataFrame, reach: int = 80, most: int = MOST_ENTITIES) -> DataFrame:
    """(scope, source, target, weight) of the entities (scope, name) of each scope: `cooccurrence` of their mentions in documents that are arrays of tokens.

    A null scope has none. Up to `most` entities go to every task, which finds them among a document's tokens and sums its pairs by scope,
    so that nothing but sums is shuffled. More are joined to the tokens.
    """
    named, rows = tables.known(entities.select(scope, "name").dropna().distinct(), most)
    if rows is None:
        tokens = docs.select(scope, doc, F.posexplode(token_list).alias("pos", "name"))
        return cooccurrence(tokens.join(named, [scope, "name"]), [scope], doc, "pos", "name", reach)
    names = sorted({r.name for r in rows})
    number = {n: i for i, n in enumerate(names)}
    of = {s: i for i, s in enumerate(sorted({r[scope] for r in rows}))}
    sent = docs.sparkSession.sparkContext.broadcast((names, of, np.sort(np.array([of[r[scope]] * len(names) + number[r.name] for r in rows], np.int64))))
    schema = docs.select(scope).schema.add("source", "string").add("target", "string").add("weight", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, of, known = sent.value
        listed = pa.array(names, pa.string())

        def mentioned(b: pa.RecordBatch, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            done = 0
            for part in slices(b, lengths(b.column(token_list)), MENTIONS):
                lists = part.column(token_list)
                size, own = lengths(lists), code[done : done + part.num_rows]
                done += part.num_rows
                found = pc.fill_null(pc.index_in(lists.flatten(), value_set=listed), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(size)), size)
                key = own[row] * len(names) + found
                place = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
                met = (own[row] >= 0) & (found >= 0) & (known[place] == key) if len(known) else np.zeros(len(found), bool)
                yield own, np.concatenate([[0], np.cumsum(np.bincount(row[met], minlength=len(size)))]), found[met]

        scopes = list(of)
        for b in batches:
            code = np.array([of.get(s, -1) for s in b.column(scope).to_pylist()], np.int64)
            found, low, high, weight = summed(mentioned(b, code), max(len(names), 1), reach)
            yield pa.RecordBatch.from_arrays([pa.array([scopes[i] for i in found.tolist()], b.column(scope).type), listed.take(pa.array(low)), listed.take(pa.array(high)), pa.array(weight)], names=[scope, "source", "target", "weight"])

    return docs.select(scope, token_list).mapInArrow(count, schema).groupBy(scope, "source", "target").agg(F.sum("weight").alias("weight"))


def degrees(links: DataFrame, scope: list[str]) -> DataFrame:
    return links.select(*scope, F.explode(F.array("source", "target")).alias("name")).groupBy(*scope, "name").agg(F.count("*").alias("degree"))


def nodes(entities: DataFrame, links: DataFrame, scope: list[str]) -> DataFrame:
    """Entities with the number of links at either end."""
    return entities.join(degrees(links, scope), [*scope, "name"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def delete_entities(entities: DataFrame, relations: DataFrame, gone: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) without the entities (scope, name) that go, and without the relations that have one of them at either end."""
    names = gone.select(scope, "name").distinct()
    left = relations
    for end in ("source", "target"):
        left = left.join(names.withColumnRenamed("name", end), [scope, end], "left_anti")
    return entities.join(names, [scope, "name"], "left_anti"), left


def ranked(candidates: DataFrame, scope: str, most: int | None = None) -> DataFrame:
    """Candidates (scope, name, freq, first) with `rank` from 1 in each scope: the frequent ones first, of equal ones what came first, then by name."""
    place = F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("freq"), "first", "name"))
    out = candidates.withColumn("rank", place.cast("long"))
    return out if most is None else out.where(F.col("rank") <= most)


def resolve(names: DataFrame, entities: DataFrame, priority: dict[str, int]) -> DataFrame:
    """Of the entities that bear a name, the one of the hinted type, else the first type by priority, then the least id."""
    rank = F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])
    found = names.join(entities, "name")
    place = F.row_number().over(Window.partitionBy("name", "hint").orderBy((F.col("type") == F.col("hint")).desc(), F.coalesce(rank[F.col("type")], F.lit(99)), "id"))
    return found.withColumn("place", place).where("place = 1").select("name", "hint", "id", "type")


def connect(relations: DataFrame, entities: DataFrame, priority: tuple[str, ...]) -> DataFrame:
    """(novel_id, source_id, target_id, type) of relations between names, each once; an end that no entity (novel_id, name, type, id) bears drops the row.

    Of several entities of one name the type that comes first in `priority` is meant.
    """
    rank = F.create_map(*[F.lit(x) for i, t in enumerate(priority) for x in (t, i)])
    ids = entities.groupBy("novel_id", "name").agg(F.min_by("id", F.struct(F.coalesce(rank[F.col("type")], F.lit(len(priority))), "id")).alias("id"))
    out = relations
    for end in ("source", "target"):
        out = out.join(ids.select("novel_id", F.col("name").alias(end), F.col("id").alias(f"{end}_id")), ["novel_id", end])
    return out.select("novel_id", "source_id", "target_id", "type").distinct()
