"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insults (a lexicon of words and word beginnings, learned with weights from labelled rows),
threats, words of intent, targets, negations and verbs of reported speech. Five small transducers, for insults, threats,
targets, negation and reported speech, are composed to one machine for each reading direction, which tags every insult
or threat of a clause: an insult said of someone, a threat that is meant, aimed at someone, negated, or reported. A clause's
weight goes to the tags' sum, and a logistic function of the sums, fitted on the same labelled rows, is the score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.llm.language_id import sampled
from fabula.llm.shared import texts
from fabula.llm.textkit import LOWER, Lookup, Words, hash_of, parts, range_hashes, text_bytes

#: Labelled rows of each class to learn from, as expected by a hash threshold.
SAMPLE_PER_CLASS = 3000
#: Least toxic rows that an entry of the lexicon must be in.
LEAST_ROWS = 4
#: Lengths in bytes of the word beginnings that may enter the lexicon.
STEMS = (4, 5, 6)
THRESHOLD = 0.3
#: By how much the weights of clauses that are aimed at someone differ at least; see `in_order`.
MARGIN = 0.5

LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = True
LETTERS[0x80:] = True
CLAUSE_ENDS = np.zeros(256, bool)
CLAUSE_ENDS[[ord(c) for c in ".,;:!?\n"]] = True

SYMBOLS = OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT = range(7)
#: Function words of the grammar.
FUNCTION_WORDS = {
    THREAT: "kill hurt destroy murder shoot stab burn beat strangle smash töten umbringen verletzen tuer frapper brûler matar golpear quemar",
    TARGET: "you your yours yourself u ur he she him her they them du dich dir dein deine ihr euch tu toi te vous votre ton tú usted ustedes vosotros",
    NEGATION: "not no never none nobody cannot nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás ningún",
    REPORT: "said says say told wrote claimed claims called reported quoted sagte sagt schrieb behauptet dit disait écrit dijo dice escribió",
    INTENT: "will shall gonna going wanna want should must let werde werden will soll vais va veux voy va quiero",
}
#: How far, in words, a negation reaches.
REACH = 3
#: And how far someone's insult, and a threat's intent, may lie before it.
NEAR = 4
TAG_TARGET, TAG_NEGATED, TAG_REPORTED, TAG_SAID, TAG_MEANT = 1, 2, 4, 8, 16


@dataclass
class Transducer:
    """States are numbers from 0, the start; by (state, symbol): the next state and the tags that the symbol gets."""

    next: list[list[int]]
    tags: list[list[int]]

    def __matmul__(self, other: Transducer) -> Transducer:
        """The composition: both read the same symbols, and their tags are united. Only states in reach are kept."""
        names, todo = {(0, 0): 0}, [(0, 0)]
        out = Transducer([], [])
        for a, b in todo:
            row, tags = [], []
            for s in range(len(self.next[0])):
                to = (self.next[a][s], other.next[b][s])
                if to not in names:
                    names[to] = len(names)
                    todo.append(to)
                row.append(names[to])
                tags.append(self.tags[a][s] | other.tags[b][s])
            out.next.append(row)
            out.tags.append(tags)
        return out

    def read(self, symbols: list[int]) -> list[int]:
        state, out = 0, []
        for s in symbols:
            out.append(self.tags[state][s])
            state = self.next[state][s]
        return out


def after(symbol: int, tag: int, of: tuple[int, ...] = (INSULT, THREAT)) -> Transducer:
    """Tags insults and threats (or one kind of them) that follow `symbol` in the clause."""
    hit = [tag if s in of else 0 for s in SYMBOLS]
    return Transducer([[int(s == symbol) for s in SYMBOLS], [1] * len(SYMBOLS)], [[0] * len(SYMBOLS), hit])


def within(symbol: int, tag: int, reach: int, of: tuple[int, ...] = (INSULT, THREAT)) -> Transducer:
    """Tags insults and threats (or one kind of them) at most `reach` words behind `symbol`."""
    hit = [tag if s in of else 0 for s in SYMBOLS]
    return Transducer([[reach if s == symbol else max(0, i - 1) for s in SYMBOLS] for i in range(reach + 1)], [[0] * len(SYMBOLS), *[hit] * reach])


INSULTS = within(TARGET, TAG_SAID, NEAR, (INSULT,))
THREATS = within(INTENT, TAG_MEANT, NEAR, (THREAT,))
FORWARD = INSULTS @ THREATS @ after(TARGET, TAG_TARGET) @ within(NEGATION, TAG_NEGATED, REACH) @ after(REPORT, TAG_REPORTED)
BACKWARD = after(TARGET, TAG_TARGET) @ after(REPORT, TAG_REPORTED)
#: Sums of a text: plain, aimed, negated, reported, and said of someone or meant.
PLAIN, AIMED, NEGATED, REPORTED, DIRECT = range(5)


def sum_of(symbol: int, tags: int) -> int | None:
    """The sum that a tagged symbol's weight goes to; a threat that is aimed at nobody counts nowhere."""
    if symbol == THREAT and not tags & TAG_TARGET:
        return None
    if tags & TAG_REPORTED:
        return REPORTED
    if tags & TAG_NEGATED:
        return NEGATED
    if tags & (TAG_SAID | TAG_MEANT):
        return DIRECT
    return AIMED if tags & TAG_TARGET else PLAIN


def in_order(weights: np.ndarray) -> np.ndarray:
    """The sums' weights in the order that the grammar gives to clauses, whatever the labelled rows say.

    A match never lowers a score. What is aimed at someone weighs more than the bare word, by MARGIN at least, and what is
    said of someone, or meant, more than that; what is negated or reported weighs half of the bare word at most.
    """
    w = np.maximum(weights, 0.0)
    w[AIMED] = max(w[AIMED], w[PLAIN] + MARGIN)
    w[DIRECT] = max(w[DIRECT], w[AIMED] + MARGIN)
    w[[NEGATED, REPORTED]] = np.minimum(w[[NEGATED, REPORTED]], w[PLAIN] / 2)
    return w


@dataclass
class Grammar:
    """Lexicon entries (bytes; a trailing * marks a word beginning) with weights, and the logistic function."""

    entries: dict[bytes, float]
    bias: float = -3.0
    weights: np.ndarray = field(default_factory=lambda: np.array([4.0, 5.0, 3.0, 2.0, 5.0]))

    def __post_init__(self) -> None:
        words = [(w, INSULT, x) for w, x in self.entries.items() if not w.endswith(b"*")]
        words += [(w.encode(), s, 0.8 if s == THREAT else 0.0) for s, ws in FUNCTION_WORDS.items() for w in ws.split() if w.encode() not in self.entries]
        self.words = Lookup(hash_of([w for w, _, _ in words]))
        self.symbol = np.array([s for _, s, _ in words], np.int8)
        self.weight = np.array([x for _, _, x in words])
        self.stems = {}
        for n in sorted({len(w) - 1 for w in self.entries if w.endswith(b"*")}):
            own = [(w[:-1], x) for w, x in self.entries.items() if w.endswith(b"*") and len(w) == n + 1]
            self.stems[n] = (Lookup(hash_of([w for w, _ in own])), np.array([x for _, x in own]))

    def sums(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By row: weights summed by tag (five sums), and the number of matched clauses."""
        low = LOWER[raw]
        words = Words(low, off, LETTERS)
        symbol, weight = np.zeros(len(words), np.int8), np.zeros(len(words))
        size = words.ends - words.starts
        for n, (table, own) in self.stems.items():
            long = np.flatnonzero(size > n)
            at, key = table.find(range_hashes(low, words.starts[long], words.starts[long] + n))
            symbol[long[at]] = INSULT
            weight[long[at]] = np.maximum(weight[long[at]], own[key])
        at, key = self.words.find(words.hashes())
        symbol[at], weight[at] = self.symbol[key], self.weight[key]
        out, clauses = np.zeros((len(off) - 1, 5)), np.zeros(len(off) - 1, np.int64)
        hits = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
        if len(hits):
            row = words.rows()
            clause = np.cumsum(CLAUSE_ENDS[low])[words.starts] + row  # grows from clause to clause and from row to row
            for c in np.unique(clause[hits]).tolist():
                i, j = np.searchsorted(clause, [c, c + 1]).tolist()
                s = symbol[i:j].tolist()
                tags = [a | b for a, b in zip(FORWARD.read(s), BACKWARD.read(s[::-1])[::-1], strict=True)]
                clauses[row[i]] += 1
                for k, x in enumerate(s):
                    if x in (INSULT, THREAT) and (to := sum_of(x, tags[k])) is not None:
                        out[row[i], to] += weight[i + k]
        return out, clauses

    def score(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + np.log1p(sums) @ self.weights)))

    def fit(self, sums: np.ndarray, toxic: np.ndarray, ridge: float = 0.5) -> None:
        """Newton steps towards the labels, held near the values that were set before."""
        x = np.column_stack([np.ones(len(sums)), np.log1p(sums)])
        prior = np.concatenate([[self.bias], self.weights])
        w = prior.copy()
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (toxic - p) - ridge * (w - prior))
            w += np.clip(step, -1, 1)
            w[1:] = in_order(w[1:])
        self.bias, self.weights = float(w[0]), w[1:]


def row_features(raw: np.ndarray, off: np.ndarray) -> list[set[bytes]]:
    low = LOWER[raw]
    words = Words(low, off, LETTERS)
    out = []
    for i, j in zip(words.row_at[:-1], words.row_at[1:], strict=True):
        own = {low[a:b].tobytes() for a, b in zip(words.starts[i:j].tolist(), words.ends[i:j].tolist(), strict=True)}
        out.append(own | {w[:n] + b"*" for w in own for n in STEMS if len(w) > n})
    return out


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())
    for b in parts(batches):
        for own, toxic in zip(row_features(*text_bytes(b.column("text"))), b.column("toxic").to_pylist(), strict=True):
            seen[toxic].update(own)
    keys = list(seen[0].keys() | seen[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *[pa.array([seen[x][k] for k in keys], pa.int64()) for x in (0, 1)]], names=["feature", "clean", "toxic"])


def choose(rows: list[set[int]], names: list[bytes], broad: int) -> list[int]:
    """Entries that are broad, or that explain at least two rows which none explains yet.

    Words that only come along in copies of one text explain nothing more once its insults are in.
    """
    where: dict[int, set[int]] = {}
    for r, own in enumerate(rows):
        for f in own:
            where.setdefault(f, set()).add(r)
    out = [f for f, at in where.items() if len(at) >= broad]
    # of a beginning and its words, the beginning stays only where it reaches further
    reach = {names[f]: len(where[f]) for f in out}
    most: dict[bytes, int] = {}
    for w, n in reach.items():
        for k in range(1, len(w)):
            most[w[:k]] = max(most.get(w[:k], 0), n if not w.endswith(b"*") or k < len(w) - 1 else 0)
    out = [f for f in out if not (names[f].endswith(b"*") and most.get(names[f][:-1], 0) >= 0.95 * reach[names[f]])]
    open_rows = set(range(len(rows))).difference(*[where[f] for f in out])
    while open_rows:
        gain = Counter(f for r in open_rows for f in rows[r])
        best = max(gain.items(), key=lambda x: (x[1], len(where[x[0]]), names[x[0]]), default=(0, 0))
        if best[1] < 2:
            break
        out.append(best[0])
        open_rows -= where[best[0]]
    return out


def learn(docs: DataFrame, labels: DataFrame, train: Column, size: int = SAMPLE_PER_CLASS) -> Grammar:
    """A grammar from labelled rows that `train` (a condition on doc_id) picks; without any, the function words alone.

    Labels that are null are left out. The sample is bounded by `size` for each class, and so the lexicon is too.
    """
    picked = labels.where(train).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    marked = F.broadcast(sampled(picked, "doc_id", "toxic", size))
    rows = texts(docs).join(marked, "doc_id").select("text", "toxic")
    totals = rows.agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")).first()
    n0, n1 = totals.clean or 0, totals.toxic or 0
    if not n1:
        return Grammar({})
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    counted = rows.mapInArrow(count_features, "feature binary, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    got = counted.where((F.col("toxic") >= LEAST_ROWS) & (F.col("clean") <= 0.01 * F.col("toxic"))).withColumn("odds", odds).orderBy(F.desc("toxic"), "feature").collect()
    names, weight = [bytes(r.feature) for r in got], [r.odds for r in got]
    place = {w: i for i, w in enumerate(names)}

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([[place[f] for f in fs if f in place] for fs in row_features(*text_bytes(b.column("text")))], pa.list_(pa.int32()))], names=["own"])

    toxic_rows = [set(r.own) for r in rows.where("toxic = 1").select("text").mapInArrow(own, "own array<int>").collect()]
    chosen = choose(toxic_rows, names, max(LEAST_ROWS, round(0.02 * n1)))
    grammar = Grammar({names[i]: float(min(weight[i], 8.0) / 8) for i in chosen})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            found, _ = grammar.sums(*text_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(found.tolist(), pa.list_(pa.float64())), b.column("toxic")], names=["sums", "toxic"])

    fitted = rows.mapInArrow(sums, "sums array<double>, toxic int").collect()
    grammar.fit(np.array([r.sums for r in fitted]), np.array([r.toxic for r in fitted], float))
    return grammar


def scores(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, n_clauses of each row. A map over partitions.

    Null text scores as empty text: the logistic function's value without any match. Repeated rows give repeated rows; a
    null doc_id stays null (and in `score_documents` is not held out); texts are read whole, however long.
    """
    sent = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            sums, clauses = sent.value.sums(*text_bytes(b.column("text")))
            score = sent.value.score(sums)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(clauses)], names=["doc_id", "score", "predicted", "n_clauses"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int, n_clauses long")


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Scores of all rows by a grammar of the labelled rows outside the held-out fold."""
    grammar = learn(docs, labels, F.coalesce(fold_of(F.col("doc_id"), folds) != held_out, F.lit(False)))
    return scores(docs, grammar).select("doc_id", F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", "predicted", "n_clauses")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows that score `threshold` or more; all columns stay, in their order."""
    grammar = learn(docs, labels, F.lit(True))
    sent = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            sums, _ = sent.value.sums(*text_bytes(b.column("text")))
            yield b.filter(pa.array(sent.value.score(sums) < threshold))

    return docs.mapInArrow(run, docs.schema)
