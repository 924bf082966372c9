"""A trigram index of texts: posting lists that are intersected, and hits that are verified.

An index is a folder. Each batch of texts adds `texts/batch=n` (key, text; a null text deletes the key) and
`postings/batch=n` (part, gram, keys), dealt to PARTS folders by the gram's hash and sorted by gram in them, so that a
search reads the files of its own grams. A key's newest batch is the one that counts. A batch whose writing was
interrupted is not in `batches/` and is written again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula import storage
from fabula.functions.segment import codes
from fabula.functions.slices import lengths, slices

PARTS = 64
#: Grams of a pattern that are intersected: the rarest. What the others would exclude, the texts do.
RAREST = 4
#: Candidates whose keys are looked up by value, so that only their files' parts are read; more are joined.
FEW = 10_000

KEYS = "part int, gram long, keys array<long>"


def pattern_pieces(pattern: str) -> list[str]:
    """What a LIKE pattern holds literally, between its wildcards, in lower case. A backslash makes the next character literal."""
    pieces, piece, literal = [], "", False
    for c in pattern:
        if not literal and c in "%_":
            pieces.append(piece)
            piece = ""
        elif not literal and c == "\\":
            literal = True
            continue
        else:
            piece += c
        literal = False
    return [p.lower() for p in [*pieces, piece] if p]


def grams(text: str) -> np.ndarray:
    """Every three characters of a text that follow one another, as one number of 63 bits."""
    c = codes(text)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in slices(whole, lengths(whole.column("text")))):
        found = [np.unique(grams(t)) for t in b.column("text").to_pylist()]
        gram = np.concatenate([np.zeros(0, np.int64), *found])
        key = np.repeat(b.column("key").to_numpy(), [len(g) for g in found])
        order = np.lexsort((key, gram))
        gram, key = gram[order], key[order]
        own, start = np.unique(gram, return_index=True)
        part = ((own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % PARTS
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(key)).astype(np.int32)), pa.array(key))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(own), lists], names=["part", "gram", "keys"])


def part_of(gram: int) -> int:
    return ((gram * 0x9E3779B97F4A7C15) % 2**64 >> 40) % PARTS


def add(docs: DataFrame, root: str, batch: int, key: str = "doc_id", text: str = "text") -> None:
    """Adds a batch of texts, which replace what earlier batches have under their keys. A batch that is there already is left as it is.

    Keys are whole numbers, each once in a batch; rows with a null key are left out.
    """
    spark = docs.sparkSession
    if str(batch) in storage.names(spark, f"{root}/batches"):
        return
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null")
    rows.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{root}/texts/batch={batch}")
    kept = spark.read.schema("key long, text string").parquet(f"{root}/texts/batch={batch}")
    lists = kept.where("text is not null").select("key", F.lower("text").alias("text")).mapInArrow(_postings, KEYS)
    lists.repartition("part").sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{root}/postings/batch={batch}")
    storage.mark(spark, f"{root}/batches/{batch}")


def _read(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """A table of all batches that are complete."""
    done = [int(n) for n in storage.names(spark, f"{root}/batches")]
    return spark.read.schema(schema + ", batch int").option("basePath", f"{root}/{table}").parquet(*[f"{root}/{table}/batch={n}" for n in done])


def texts(spark: SparkSession, root: str) -> DataFrame:
    """(key, text) as the newest batch of each key has it."""
    rows = _read(spark, root, "texts", "key long, text string")
    newest = rows.groupBy("key").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["key", "batch"]).where("text is not null").select("key", "text")


def candidates(spark: SparkSession, root: str, pattern: str) -> DataFrame | None:
    """(key, batch) of the texts that hold the rarest grams of a pattern; None for a pattern without any gram."""
    wanted = sorted({int(g) for p in pattern_pieces(pattern) for g in grams(p)})
    if not wanted:
        return None
    lists = _read(spark, root, "postings", KEYS)
    lists = lists.where(F.col("part").isin(sorted({part_of(g) for g in wanted})))
    sizes = {r.gram: r.n for r in lists.where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum(F.size("keys")).alias("n")).collect()}
    chosen = sorted(wanted, key=lambda g: (sizes.get(g, 0), g))[:RAREST]
    met = lists.where(F.col("part").isin(sorted({part_of(g) for g in chosen})) & F.col("gram").isin(chosen)).select(F.explode("keys").alias("key"), "batch")
    # each list has a key once, so that a key's rows are its grams
    return met.groupBy("key", "batch").count().where(F.col("count") == len(chosen)).select("key", "batch")


def search(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(key, text) of all texts that are ILIKE the pattern. A pattern without three literal characters in a row is looked for in all texts."""
    found = candidates(spark, root, pattern)
    if found is None:
        return texts(spark, root).where(F.col("text").ilike(pattern))
    rows = _read(spark, root, "texts", "key long, text string")
    few = found.limit(FEW + 1).collect()
    if len(few) <= FEW:
        keys = sorted({r.key for r in few})
        rows = rows.where(F.col("key").isin(keys))
        found = spark.createDataFrame(few, "key long, batch int")
    newest = rows.join(found.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.max("batch").alias("batch"))
    return rows.join(found.join(newest, ["key", "batch"]), ["key", "batch"]).where(F.col("text").ilike(pattern)).select("key", "text")


def compact(spark: SparkSession, root: str, into: str) -> None:
    """Writes an index of one batch with what the batches of `root` leave."""
    add(texts(spark, root), into, 0, "key", "text")
