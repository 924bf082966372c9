"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed byte n-grams of its lower-cased bytes; each language has several centroids,
clustered on a bounded sample of labelled texts. A prediction takes the centroid of greatest cosine. A text whose
distance to it exceeds what the language's own sample shows is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.llm.textkit import LOWER, parts, text_bytes

DIMENSIONS = 4096
GRAMS = (1, 2, 3)
#: Labelled texts of each language to fit on, as expected by a hash threshold.
SAMPLE_PER_LANGUAGE = 400
#: And of all languages together, about, each 16 KB at the driver: with very many languages each gives fewer texts, and at least one.
SAMPLE_ROWS = 16_000
#: Groups whose sizes are broadcast; of more, rows are joined to them.
BROADCAST_GROUPS = 100_000
CENTROIDS = 4
#: Texts whose vectors a task holds at once.
ROWS_AT_ONCE = 256


def counts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows of n-gram counts, hashed to DIMENSIONS."""
    low = LOWER[raw]
    low = np.where((low < 0x61) & (low < 0x80) | (low > 0x7A) & (low < 0x80), np.uint8(0x20), low).astype(np.uint32)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(off))
    out = np.zeros((len(off) - 1) * DIMENSIONS)
    gram = np.zeros(len(low), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(low) < n:
            break
        gram = (gram[: len(low) - n + 1] << np.uint32(8)) | low[n - 1 :]
        if n in GRAMS:
            slot = ((gram + np.uint32(n << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - (DIMENSIONS - 1).bit_length())
            at = row[: len(gram)] * DIMENSIONS + slot
            if n > 1:
                at = at[row[: len(gram)] == row[n - 1 :]]
            out += np.bincount(at, minlength=len(out))
    return out.reshape(-1, DIMENSIONS).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray  # by language: the cosine below which a text is rejected

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        x = np.sqrt(tf) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def predict(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = self.vectors(tf) @ self.centroids.T
        best = near.argmax(1)
        return self.owner[best], near[np.arange(len(near)), best]


def clusters(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    seeds = [int((x @ x.mean(0)).argmax())]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def sampled(rows: DataFrame, key: str, group: str, size: int, most: int = SAMPLE_ROWS) -> DataFrame:
    """Rows whose id's hash is below a threshold that leaves about `size` of each group (all of a smaller one), or an equal share of `most`, if that is less.

    Of every group at least the row of the least hash is in.
    """
    hashed = rows.withColumn("_hash", F.pmod(F.xxhash64(key), F.lit(1 << 30)))
    groups = hashed.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.min("_hash").alias("_least"))
    n = groups.count()
    each = min(size, max(1, most // max(1, n)))
    # up to so many groups, rows are looked at where they are read
    met = hashed.join(F.broadcast(groups) if n <= BROADCAST_GROUPS else groups, group).where((F.col("_hash") < F.lit(each / 1.0) / F.col("_n") * (1 << 30)) | (F.col("_hash") == F.col("_least")))
    return met.select(*rows.columns)


def sample_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches, rows=ROWS_AT_ONCE):
        tf = counts(*text_bytes(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([x.tobytes() for x in tf], pa.binary())], names=["lang", "tf"])


def fit(docs: DataFrame, train: Column, size: int = SAMPLE_PER_LANGUAGE, k: int = CENTROIDS) -> Model | None:
    """The model of the rows that `train` picks and whose lang and text are not null; None where there are none."""
    rows = docs.where(train).select(F.col("doc_id").alias("doc_id"), F.col("lang").alias("lang"), F.col("text").alias("text")).where("lang is not null and text is not null")
    got = sampled(rows, "doc_id", "lang", size).select("lang", "text").mapInArrow(sample_vectors, "lang string, tf binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.lang, bytes(r.tf)))
    tf = np.stack([np.frombuffer(r.tf, np.float32) for r in got])
    lang = np.array([r.lang for r in got])
    names = sorted(set(lang.tolist()))
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32)
    model = Model(names, idf, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.int64), np.zeros(len(names), np.float32))
    x = model.vectors(tf)
    groups = [clusters(x[lang == n], k) for n in names]
    model.centroids = np.concatenate(groups).astype(np.float32)
    model.owner = np.repeat(np.arange(len(names)), [len(g) for g in groups])
    for i, n in enumerate(names):
        near = (x[lang == n] @ groups[i].T).max(1)
        model.least[i] = np.quantile(near, 0.01) * 0.8
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (the cosine, 0 to 1), rejected. Null texts and texts without a letter are `und`, score 0.

    Of centroids that are equally near the first counts, in the order of their languages' names. Whole texts are read,
    however long. Repeated rows give repeated rows; a null doc_id stays null. Without a model all rows are `und`.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in parts(batches, rows=ROWS_AT_ONCE):
            lettered = b.column("lettered").to_numpy(zero_copy_only=False)
            if m is None:
                names, score, rejected = ["und"] * b.num_rows, np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            else:
                own, near = m.predict(counts(*text_bytes(b.column("text"))))
                names = [m.languages[i] if has else "und" for i, has in zip(own.tolist(), lettered.tolist(), strict=True)]
                score = np.where(lettered, np.clip(near, 0, 1), 0.0).astype(np.float64)
                rejected = ~lettered | (near < m.least[own])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Predictions for all rows by a model of the rows outside the held-out fold (crc32 of doc_id as text)."""
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    model = fit(docs, F.coalesce(fold != held_out, F.lit(False)))
    kept = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_out, F.lit(False))
    return predict(docs, model).select("doc_id", kept.alias("held_out"), "lang_pred", "score", "rejected")
