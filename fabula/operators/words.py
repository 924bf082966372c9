"""Tokens of any language: runs of letters, those of ideographs cut by a dictionary; and where names stand in texts."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import TypeVar

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.functions.excerpts import around, around_both
from fabula.functions.segment import HAN, RUN, WHOLE, Words
from fabula.functions.slices import BYTES, lengths, slices, text_lengths
from fabula.operators import tables

LETTERS = r"\p{L}+"
#: Words of a dictionary that is broadcast, and names that are; see `load` and `with_names`.
MOST_WORDS, MOST_NAMES = 2_000_000, 200_000
#: Scopes whose words or names a task keeps at hand.
REMEMBERED = 64

T = TypeVar("T")


class Recent(OrderedDict):
    """The last REMEMBERED values that were made, by their keys."""

    def made(self, key: object, make: Callable[[], T]) -> T:
        if key not in self:
            self[key] = make()
            if len(self) > REMEMBERED:
                self.popitem(last=False)
        self.move_to_end(key)
        return self[key]


def load(dictionary: DataFrame, most: int = MOST_WORDS) -> Words:
    """The dictionary (word, freq) of a language, to be broadcast: it does not grow with the texts. One of more than `most` words is refused."""
    rows = dictionary.select("word", F.col("freq").cast("double").alias("freq")).where("word is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a dictionary of more than {most} words is too large to be broadcast")
    return Words.of([(r.word, r.freq) for r in rows])


def token_lists(docs: DataFrame, keys: list[str], text: str, words: Words | None = None, scope: str | None = None, own: DataFrame | None = None) -> DataFrame:
    """(keys, tokens) of the lower-cased texts: runs of letters, and runs of ideographs cut by `words` and by `own`.

    `own` (scope, word, freq) are words that hold within their scope only; those of a scope go along with its texts. Only
    texts with ideographs go through Python, so the table is read for each of the two kinds. Without `words` every run
    of letters is one token, in whatever language. Null texts have no row.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))
    docs = docs.where(F.col(text).isNotNull())
    if words is None:
        return docs.select(*keys, runs.alias("tokens"))
    # looked for only where some character takes more than a byte
    spaceless = (F.octet_length(text) > F.length(text)) & F.col(text).rlike(f"[{HAN}]")
    plain = docs.where(~spaceless).select(*keys, runs.alias("tokens"))
    rest = docs.where(spaceless).select(*keys, F.col(scope).alias("_scope") if scope else F.lit(None).cast("string").alias("_scope"), runs.alias("_runs"))
    if own is not None:
        listed = own.groupBy(F.col(scope).alias("_scope")).agg(F.array_sort(F.collect_list(F.struct("word", F.col("freq").cast("double").alias("freq")))).alias("_own"))
        rest = rest.join(listed, "_scope", "left")
    else:
        rest = rest.withColumn("_own", F.lit(None).cast("array<struct<word:string,freq:double>>"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for b in (part for whole in batches for part in slices(whole, text_lengths(whole.column("_runs")), BYTES // 4)):
            out: list[list[str]] = [[]] * b.num_rows
            rows, owns, groups = b.column("_runs").to_pylist(), b.column("_own"), {}
            for i, s in enumerate(b.column("_scope").to_pylist()):
                groups.setdefault(s, []).append(i)
            for s, at in groups.items():
                recent.made(s, lambda s=s, i=at[0]: words.add(s, [(w["word"], w["freq"]) for w in owns[i].as_py() or []]))
                cuts = iter(words.tokens([r for i in at for r in rows[i]], s))
                for i in at:
                    out[i] = [w for _ in rows[i] for w, _ in next(cuts)]
                words.keep(recent)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array(out, pa.list_(pa.string()))], names=[*keys, "tokens"])

    return plain.unionByName(rest.mapInArrow(cut, plain.schema))


def tokens(docs: DataFrame, keys: list[str], text: str, words: Words | None = None, scope: str | None = None, own: DataFrame | None = None) -> DataFrame:
    """(keys, pos, token) of `token_lists`."""
    # outer: else Spark would look for the tokens once more, in a filter for texts that have any
    return token_lists(docs, keys, text, words, scope, own).select(*keys, F.posexplode_outer("tokens").alias("pos", "token")).where("pos is not null")


def with_names(docs: DataFrame, names: DataFrame, scope: str, name: str = "name", most: int = MOST_NAMES) -> DataFrame:
    """`docs` with `_names`, all names of their scope; documents of a scope without any are left out.

    Up to `most` names are computed once and broadcast; of more, the lists are joined as Spark sees fit.
    """
    named = names.where(F.length(name) > 0).select(scope, F.col(name).alias("_names"))
    known, rows = tables.known(named, most)
    listed = known.groupBy(scope).agg(F.array_sort(F.collect_set("_names")).alias("_names"))
    return docs.join(listed if rows is None else F.broadcast(listed), scope)


def automaton(names: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, n in enumerate(names):
        out.add_word(n, i)
    out.make_automaton()
    return out


def told(b: pa.RecordBatch, keys: list[str], rows: list[int], **columns: pa.Array) -> pa.RecordBatch:
    """The keys of the rows of `b` that something was found in, and what it is. Only keys are taken: texts would come once for each finding."""
    at = b.select(keys).take(pa.array(rows, pa.int64()))
    return pa.RecordBatch.from_arrays([*at.columns, *columns.values()], names=[*keys, *columns])


def mentions(docs: DataFrame, keys: list[str], text: str, names: DataFrame, scope: str, name: str = "name") -> DataFrame:
    """(keys, name, n, first) of each name that a text contains: how often, without overlaps, and where first.

    A text is read once for all names of its scope, by their automaton. Null texts contain none.
    """
    named = with_names(docs, names, scope, name).select(*keys, F.col(scope).alias("_scope"), F.coalesce(text, F.lit("")).alias("_text"), "_names")
    schema = named.select(*keys).schema.add("name", "string").add("n", "long").add("first", "long")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for b in (part for whole in batches for part in slices(whole, lengths(whole.column("_text")))):
            rows, found, counts, firsts = [], [], [], []
            texts, names_of = b.column("_text").to_pylist(), b.column("_names")
            for i, (own, t) in enumerate(zip(b.column("_scope").to_pylist(), texts, strict=True)):
                listed, machine = recent.made(own, lambda i=i: ((x := names_of[i].as_py()), automaton(x)))
                seen: dict[int, list[int]] = {}
                for end, k in machine.iter(t):
                    start = end + 1 - len(listed[k])
                    last = seen.setdefault(k, [0, start, 0])
                    if start >= last[2]:
                        last[0], last[2] = last[0] + 1, end + 1
                for k, (n, first, _) in seen.items():
                    rows.append(i)
                    found.append(listed[k])
                    counts.append(n)
                    firsts.append(first)
            yield told(b, keys, rows, name=pa.array(found, pa.string()), n=pa.array(counts, pa.int64()), first=pa.array(firsts, pa.int64()))

    return named.mapInArrow(find, schema)


def standing(text: str, names: list[str], machine: ahocorasick.Automaton) -> tuple[dict[str, list[int]], list[tuple[int, int]]]:
    """The names inside a text with the places where they are stretches of letters of their own; and the runs of ideographs (start, stop) that hold others, to be cut."""
    places: dict[int, list[int]] = {}
    inside: list[int] = []
    for end, k in machine.iter(text):
        name, own = names[k], places.setdefault(k, [])
        start = end + 1 - len(name)
        if RUN.fullmatch(name):
            inside.append(start)
        elif WHOLE.fullmatch(name) and not (start and WHOLE.match(text, start - 1, start)) and not WHOLE.match(text, end + 1, end + 2):
            own.append(start)
    inside.sort()
    cut = [m.span() for m in RUN.finditer(text) if bisect_left(inside, m.start()) < bisect_left(inside, m.end())] if inside else []
    return {names[k]: places[k] for k in sorted(places)}, cut


def contexts(docs: DataFrame, keys: list[str], text: str, names: DataFrame, scope: str, words: Words | None = None, before: int = 200, after: int = 400, limit: int = 4000) -> DataFrame:
    """(keys, name, context) of each name (scope, name) that a text contains: what stands around the places where it is a word of its own.

    A text is cut into words once for all names. A name that is only part of other words, such as a longer word of the
    dictionary, gets the text's beginning. The scope's names are words of the dictionary.
    """
    words = words or Words.of([])
    named = with_names(docs, names, scope).select(*keys, F.col(scope).alias("_scope"), F.coalesce(text, F.lit("")).alias("_text"), "_names")
    schema = named.select(*keys).schema.add("name", "string").add("context", "string")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for b in (part for whole in batches for part in slices(whole, lengths(whole.column("_text")))):
            rows, found, texts, size = [], [], [], 0
            names_of, all_texts, scopes = b.column("_names"), b.column("_text").to_pylist(), b.column("_scope").to_pylist()

            def known(i: int) -> tuple[list[str], ahocorasick.Automaton]:
                def make() -> tuple[list[str], ahocorasick.Automaton]:
                    listed = names_of[i].as_py()
                    words.add(scopes[i], [(n, None) for n in listed])
                    return listed, automaton(listed)

                out = recent.made(scopes[i], make)
                words.keep(recent)
                return out

            places, runs = [], {}
            for i, t in enumerate(all_texts):
                listed, machine = known(i)
                own, cut = standing(t, listed, machine)
                places.append(own)
                if cut:
                    runs.setdefault(scopes[i], []).extend((i, at, stop) for at, stop in cut)
            for own, spans in runs.items():
                known(spans[0][0])
                for (i, at, _), ws in zip(spans, words.cut([all_texts[i][at:stop] for i, at, stop in spans], own)):
                    for w in ws:
                        if w in places[i]:
                            places[i][w].append(at)
                        at += len(w)
            for i, t in enumerate(all_texts):
                for n, hits in places[i].items():
                    rows.append(i)
                    found.append(n)
                    texts.append(around(t, hits, before, after, limit))
                    size += len(texts[-1])
                    if size >= BYTES:
                        yield told(b, keys, rows, name=pa.array(found, pa.string()), context=pa.array(texts, pa.string()))
                        rows, found, texts, size = [], [], [], 0
            yield told(b, keys, rows, name=pa.array(found, pa.string()), context=pa.array(texts, pa.string()))

    return named.mapInArrow(pick, schema)


def pair_contexts(docs: DataFrame, keys: list[str], text: str, pairs: DataFrame, scope: str, before: int = 150, after: int = 300, limit: int = 3000) -> DataFrame:
    """(keys, source, target, context) of each pair (scope, source, target) whose two names a text contains: windows around the first that hold the second.

    A text is read once for all names of its scope's pairs; a pair's windows are then found among the places of its names.
    """
    listed = pairs.select(scope, F.to_json(F.array("source", "target")).alias("name"))
    named = with_names(docs, listed, scope).select(*keys, F.col(scope).alias("_scope"), F.coalesce(text, F.lit("")).alias("_text"), "_names")
    schema = named.select(*keys).schema.add("source", "string").add("target", "string").add("context", "string")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for b in (part for whole in batches for part in slices(whole, lengths(whole.column("_text")))):
            rows, sources, targets, texts, size = [], [], [], [], 0
            pairs_of = b.column("_names")

            def out() -> pa.RecordBatch:
                return told(b, keys, rows, source=pa.array(sources, pa.string()), target=pa.array(targets, pa.string()), context=pa.array(texts, pa.string()))

            for i, (own, t) in enumerate(zip(b.column("_scope").to_pylist(), b.column("_text").to_pylist(), strict=True)):

                def known(i: int = i) -> tuple[list[list[str]], list[str], ahocorasick.Automaton]:
                    both = [json.loads(p) for p in pairs_of[i].as_py()]
                    singles = sorted({x for p in both for x in p if x})
                    return both, singles, automaton(singles)

                both, singles, machine = recent.made(own, known)
                places: dict[str, list[int]] = {}
                for end, k in machine.iter(t):
                    places.setdefault(singles[k], []).append(end + 1 - len(singles[k]))
                for source, target in both:
                    if source in places and target in places:
                        rows.append(i)
                        sources.append(source)
                        targets.append(target)
                        texts.append(around_both(t, source, places[source], target, places[target], before, after, limit))
                        size += len(texts[-1])
                        if size >= BYTES:
                            yield out()
                            rows, sources, targets, texts, size = [], [], [], [], 0
            yield out()

    return named.mapInArrow(pick, schema)
