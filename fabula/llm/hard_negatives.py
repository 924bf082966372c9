"""Hard negatives by branch and bound over ball trees.

Rows are dealt out by a hash of their id and become trees of bounded size, several to a slot. Queries (an anchor, or an
anchor and a positive with a window of scores) are packed to blocks, a copy of which goes to every slot and meets its
trees one after the other; the best answers of a slot, k a query, are what leaves it. The same search finds positives,
in the nodes of the anchor's label, and negatives, in all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.llm.ball_tree import LEAST, MOST, Asked, Tree, build, search
from fabula.llm.shared import passing, slots, stored, tasks
from fabula.llm.vectors import matrix, whole

#: Rows of a tree, about: some 4 MB at 64 components.
TREE_ROWS = 8192
#: Queries of a block, about.
BLOCK = 1024
#: Blocks whose answers a task holds while it waits for further trees.
OPEN = 16

TREES = "slot int, " + ", ".join(f"{n} binary" for n in Tree.KINDS)
ANSWERS = "anchor_id long, positive_id long, vec_id long, score long"


def labelled(rows: DataFrame, label: Column, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part; of several rows with one id only the least (label, components)."""
    sound = whole(rows, scale, vec_id, embedding, label=label.cast("long")).where("vec_id is not null and label is not null")
    return sound.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("row")).select("vec_id", "row.label", "row.vec")


def planted(rows: DataFrame, tree_rows: int) -> DataFrame:
    """The rows as trees, dealt to slots. A task builds one tree at a time."""
    spark = rows.sparkSession
    of, n = slots(spark), tasks(spark)
    trees = max(1, -(-rows.count() // (n * tree_rows)))
    number = F.pmod(F.xxhash64("vec_id"), F.lit(n * trees))
    dealt = rows.withColumns({"slot": F.array(*map(F.lit, of))[(number % n).cast("int")], "tree": F.floor(number / n)})

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        which: tuple[int, int] | None = None

        def grown() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            tree = build(t.column("vec_id").to_numpy(), t.column("label").to_numpy(), matrix(t.column("vec")))
            packed = tree.packed()
            return pa.RecordBatch.from_arrays([pa.array([which[0]], pa.int32()), *[pa.array([x], pa.binary()) for x in packed.values()]], names=["slot", *packed])

        for b in batches:
            own = np.stack([b.column("slot").to_numpy(), b.column("tree").to_numpy()], 1)
            cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1).tolist(), len(own)] if len(own) else [0]
            for s, e in zip(cuts, cuts[1:]):
                if held and which != tuple(own[s].tolist()):
                    yield grown()
                    held = []
                which = tuple(own[s].tolist())
                held.append(b.slice(s, e - s))
        if held:
            yield grown()

    return dealt.repartition(n, "slot").sortWithinPartitions("slot", "tree").mapInArrow(grow, TREES)


def answered(trees: DataFrame, queries: DataFrame, k: int, same_label: bool, block: int) -> DataFrame:
    """(anchor_id, positive_id, vec_id, score, rank) of the k best answers to each of `queries` (anchor_id, positive_id, label, low, high, vec)."""
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // block))
    number = F.pmod(F.xxhash64("anchor_id", "positive_id"), F.lit(blocks))
    packed = queries.groupBy(number.alias("block")).agg(F.collect_list(F.struct("anchor_id", "positive_id", "label", "low", "high", "vec")).alias("asked"))
    everywhere = packed.withColumn("slot", F.explode(F.array(*map(F.lit, slots(spark)))))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[int, tuple[np.ndarray, Asked]] = {}

        def answers(positive: np.ndarray, asked: Asked) -> pa.RecordBatch:
            q, at = np.nonzero(asked.scores > LEAST)
            return pa.RecordBatch.from_arrays([pa.array(asked.own[q]), pa.array(positive[q]), pa.array(asked.ids[q, at]), pa.array(asked.scores[q, at])], names=["anchor_id", "positive_id", "vec_id", "score"])

        for b in batches:
            for i, n in enumerate(b.column("block").to_pylist()):
                if n not in pending:
                    if len(pending) == OPEN:
                        yield answers(*pending.pop(next(iter(pending))))
                    rows = b.column("asked").slice(i, 1).flatten()
                    column = lambda name: rows.field(name).to_numpy(zero_copy_only=False)
                    pending[n] = column("positive_id"), Asked.of(column("anchor_id"), column("label"), column("low"), column("high"), matrix(rows.field("vec")), k)
                search(Tree.unpacked({x: b.column(x)[i].as_py() for x in Tree.KINDS}), pending[n][1], same_label)
        for p in pending.values():
            yield answers(*p)

    best = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id"))
    # Spark sizes the copies as one of them, so it would broadcast them all through the driver
    return trees.join(everywhere.hint("merge"), "slot").drop("slot").mapInArrow(meet, ANSWERS).withColumn("rank", best).where(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    tree_rows: int = TREE_ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for whose vec_id `is_anchor` holds. An anchor's positives are the other rows of its label with
    the highest inner products; a positive's negatives those of other labels that score `low` to `high` hundredths of it,
    highest first, ties to the smaller id. Rows with a null id, label or vector, or a null or non-finite component, take
    no part; of several rows with one id only the least (label, components) does; shorter vectors are filled up with
    zeros. Scores are exact, and one that a long cannot hold is an error. A positive with a negative score has an empty window. An empty
    table, or one without anchors, gives an empty result.
    """
    with passing() as kept:
        own = stored(labelled(rows, label, scale, vec_id, embedding), "labelled")
        trees = stored(planted(own, tree_rows), "trees")
        anchors = own.where(is_anchor).withColumnRenamed("vec_id", "anchor_id")
        asked = anchors.select("anchor_id", F.lit(0).cast("long").alias("positive_id"), "label", F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"), "vec")
        near = answered(trees, asked, positives, True, block).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        pairs = stored(near, "positives")
        # the least and the greatest whole score of the window
        least, most = f"(positive_score * {low} + pmod(positive_score * -{low}, 100)) div 100", f"(positive_score * {high} - pmod(positive_score * {high}, 100)) div 100"
        windows = pairs.join(anchors.hint("merge"), "anchor_id").select("anchor_id", "positive_id", "label", F.expr(least).alias("low"), F.expr(most).alias("high"), "vec").where("low <= high")
        found = answered(trees, windows, negatives, False, block)
        result = stored(found.join(pairs.hint("merge"), ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
        kept.append(result)
    return result
