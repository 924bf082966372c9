"""Near-duplicates by MinHash signatures, a multi-index Hamming join, and a check on the full sets.

A text's shingle set gets a signature of b-bit minima. Signatures are split into chunks; by the pigeonhole
principle two of distance at most CHUNKS * (ERRORS + 1) - 1 have a chunk with at most ERRORS = 1 differing
values, so each signature enters, for each chunk, one key for every value that may differ: all pairs within the
distance meet under some key. Equal sets are one class with one representative. Representatives that share a key
are first looked at against the key's smallest id, and linked where the full sets confirm it; then only pairs
whose ends these links leave in different components are looked at, each under the first key that it shares.

Before texts are read, a pair must pass what is certain without them: the sizes of the sets, and an upper bound of
their intersection from bitmaps (an element whose bit the other set lacks is not in it). Only pairs of ids are moved to
the texts, which lie in buckets of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm import packed
from fabula.llm.components import connected
from fabula.llm.shared import bucketed, drop, passing, slots, stored, tasks, texts
from fabula.llm.textkit import LOWER, SPACE_WORDS, Words, mix, parts, prefix, slices, text_bytes

CHUNKS, WIDTH, ERRORS = 19, 5, 1
VALUES = CHUNKS * WIDTH
#: Greatest number of differing signature values for which the join is complete. Of two sets of similarity 0.8
#: the signatures differ in 19 values on average, with a standard deviation of 3.9.
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Members of a key that are compared as one block; a larger key's blocks are compared with blocks of its minority.
BLOCK = 1024
#: Members that a star has at most, about, and pairs of one id that are checked in one place.
STAR, HUB = 64, 256
#: Bits of a bitmap for each element of its set, at least.
BITS = 8
#: Pairs that a task compares at once.
AT_ONCE = 1 << 15

_RNG = np.random.Generator(np.random.PCG64(77))
XORS = _RNG.integers(0, 2**32, VALUES, dtype=np.uint32)
ODDS = _RNG.integers(0, 2**31, (2, VALUES), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_hashes(words: Words, n: int, which: int = 0) -> list[np.ndarray]:
    """By row the hashes of its n-word shingles, in their order; of a shorter text, the whole sequence's."""
    p = prefix(words.hashes(which), which)
    starts = np.arange(max(0, len(words) - n + 1))
    h = slices(p, starts, starts + n, which) if len(starts) else np.zeros(0, np.uint64)
    out = []
    for i, j in zip(words.row_at[:-1].tolist(), words.row_at[1:].tolist(), strict=True):
        if j - i >= n:
            out.append(h[i : j - n + 1])
        else:
            out.append(slices(p, np.array([i]), np.array([j]), which) if j > i else np.zeros(0, np.uint64))
    return out


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    return [np.unique(h) for h in shingle_hashes(words, n)]


@dataclass
class Sets:
    """The shingle sets of a batch, and 128-bit digests of them from two independent hashes of each word."""

    sets: list[np.ndarray]
    digests: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, n: int) -> Sets:
        raw, off = text_bytes(column)
        words = Words(LOWER[raw], off, SPACE_WORDS)
        sets, digests = [], []
        for x, y in zip(shingle_hashes(words, n), shingle_hashes(words, n, 1), strict=True):
            own, at = np.unique(x, return_index=True)
            sets.append(own)
            digests.append((own.sum(dtype=np.uint64), mix(y[at] + own).sum(dtype=np.uint64)))
        return cls(sets, np.array(digests, np.uint64).reshape(-1, 2).view(np.int64))

    def sizes(self) -> np.ndarray:
        return np.array([len(s) for s in self.sets], np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of VALUES 16-bit minima; zeros for an empty set."""
    out = np.zeros((len(sets), VALUES), np.uint16)
    full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if len(full):
        sizes = [len(sets[i]) for i in full]
        x = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        for k in range(VALUES):
            v = (x ^ XORS[k]) * ODDS[0, k]
            v ^= v >> np.uint32(15)
            v *= ODDS[1, k]
            v ^= v >> np.uint32(16)
            out[full, k] = np.minimum.reduceat(v, at) & np.uint32(0xFFFF)
    return out


def bitmap(own: np.ndarray) -> bytes:
    """Bits of a set's elements, by their low bits; a power of two of them, so that a larger bitmap folds to a smaller one."""
    size = 1 << max(6, (BITS * len(own) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(own & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(x: list[bytes], y: list[bytes], nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of sets whose sizes and bitmaps leave a similarity of `percent` possible; none that has it is left out."""
    out = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
    lx, ly = np.array([len(b) for b in x], np.int64), np.array([len(b) for b in y], np.int64)
    shape = np.where(out, lx * (1 << 32) + ly, -1)
    for both in np.unique(shape[out]).tolist():
        at = np.flatnonzero(shape == both)
        a, b = (np.frombuffer(b"".join([z[i] for i in at.tolist()]), np.uint8).reshape(len(at), -1) for z in (x, y))
        width = min(a.shape[1], b.shape[1])
        a, b = (np.bitwise_or.reduce(z.reshape(len(at), -1, width), axis=1).view(np.uint64) for z in (a, b))
        least = lambda n, z: n[at] - np.bitwise_count(z).sum(1, dtype=np.int64)
        most = np.minimum(least(nx, a & ~b), least(ny, b & ~a))
        out[at] = 100 * most >= percent * (nx[at] + ny[at] - most)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """Rows of keys: for each chunk and each value in it, a hash of the chunk's other values."""
    x = mix(sig.astype(np.uint64) + (np.arange(VALUES, dtype=np.uint64) << np.uint64(16)) + np.uint64(1))
    whole = x.reshape(-1, CHUNKS, WIDTH).sum(2, dtype=np.uint64)
    return mix(np.repeat(whole, WIDTH, axis=1) - x + np.arange(VALUES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def digests(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            s = Sets.of(b.column("text"), n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s.sizes()), pa.array(s.digests[:, 0]), pa.array(s.digests[:, 1])], names=["doc_id", "n_shingles", "d1", "d2"])

    return run


def sketches(n: int):
    """Size, signature and bitmap of the texts whose digests are those that are asked for (rows of one id may differ), once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in parts(batches):
            s = Sets.of(b.column("text"), n)
            fit = (s.digests[:, 0] == b.column("d1").to_numpy()) & (s.digests[:, 1] == b.column("d2").to_numpy()) & (s.sizes() == b.column("n_shingles").to_numpy())
            ids = b.column("doc_id").to_pylist()
            at = np.array([i for i in np.flatnonzero(fit).tolist() if ids[i] not in seen and not seen.add(ids[i])], np.int64)
            sets = [s.sets[i] for i in at.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), pa.array(s.sizes()[at].astype(np.int32)), pa.array([x.tobytes() for x in signatures(sets)], pa.binary()), pa.array([bitmap(x) for x in sets], pa.binary())], names=["doc_id", "size", "sig", "bits"])

    return run


PLANES = {"keys": np.uint64, "ids": np.int64}


def spread(slot_ids: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4000):
                own = b.slice(i, 4000)
                keys = chunk_keys(signature_rows(own.column("sig")))
                ids = np.repeat(own.column("doc_id").to_numpy(), VALUES)
                yield packed.deal(slot_ids, keys.ravel(), {"keys": keys.ravel(), "ids": ids})

    return run


def signature_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, VALUES)


MET = "key long, large boolean, block int, blocks int, least long, members array<long>, pivots array<long>"


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the keys with several members (no key; members and their pivots), each pair once in a task; and of keys
    with more than two the members, in blocks of at most BLOCK."""
    got = packed.gather(batches, PLANES)
    order = np.lexsort((got["ids"], got["keys"]))
    keys, ids = got["keys"][order], got["ids"][order]
    del got, order
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids = keys[new], ids[new]
    _, start, size = np.unique(keys, return_index=True, return_counts=True)
    several = np.repeat(size > 1, size)
    pivots = np.repeat(ids[start], size)
    out = []
    for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        own = ids[s : s + n]
        if n > STAR:  # stars of about STAR members around the least id of each part, and a star of those
            part = mix(own.view(np.uint64)) % np.uint64(1 << (n // STAR).bit_length())
            at = np.argsort(part, kind="stable")
            _, first, count = np.unique(part[at], return_index=True, return_counts=True)
            pivots[s + at] = np.repeat(own[at[first]], count)
            pivots[s + at[first]] = own[0]
        blocks = -(-n // BLOCK)
        out += [(int(keys[s].view(np.int64)), n > STAR, i, blocks, int(own[0]), own[i * BLOCK : (i + 1) * BLOCK], []) for i in range(blocks)]
    star = np.flatnonzero(several & (pivots != ids))
    star = star[np.lexsort((ids[star], pivots[star]))]
    once = np.ones(len(star), bool)
    once[1:] = (pivots[star][1:] != pivots[star][:-1]) | (ids[star][1:] != ids[star][:-1])
    star = star[once]
    out += [(None, False, 0, 0, None, ids[star[i : i + BLOCK]], pivots[star[i : i + BLOCK]]) for i in range(0, len(star), BLOCK)]
    kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    for i in range(0, len(out), 2000):
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out[i : i + 2000]], t) for k, t in enumerate(kinds)], names=["key", "large", "block", "blocks", "least", "members", "pivots"])


def near(percent: int):
    """Of (a, b, and both sizes, signatures and bitmaps) the pairs within DISTANCE whose sets may be alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(i, AT_ONCE)
                x, y = (signature_rows(b.column(c)) for c in ("sig_a", "sig_b"))
                b = b.filter(pa.array((x != y).sum(1) <= DISTANCE))
                nx, ny = (b.column(c).to_numpy().astype(np.int64) for c in ("size_a", "size_b"))
                fit = may_link(b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist(), nx, ny, percent)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(fit))

    return run


def exact_sets(words: Words, n: int) -> list[set]:
    """The shingle sets in bytes of words, for the batch in which two words share a hash."""
    rows = [[words.data[s:e].tobytes() for s, e in zip(words.starts[i:j].tolist(), words.ends[i:j].tolist(), strict=True)] for i, j in zip(words.row_at[:-1].tolist(), words.row_at[1:].tolist(), strict=True)]
    return [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set() for w in rows]


def verify(n: int, percent: int):
    """Of (a, b, text_a, text_b) the pairs whose full sets are alike; words of one hash are compared byte by byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(parts(batches, "text_a"), "text_b"):
            both = pa.chunked_array([b.column("text_a"), b.column("text_b")]).combine_chunks()
            raw, off = text_bytes(both)
            words = Words(LOWER[raw], off, SPACE_WORDS)
            if words.collide(words.hashes()):
                sets = exact_sets(words, n)
                common = np.array([len(x & y) for x, y in zip(sets[: b.num_rows], sets[b.num_rows :], strict=True)])
            else:
                sets = shingle_sets(words, n)
                common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(sets[: b.num_rows], sets[b.num_rows :], strict=True)])
            size = np.array([len(s) for s in sets])
            union = size[: b.num_rows] + size[b.num_rows :] - common
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array((100 * common >= percent * union) & (union > 0)))

    return run


def first_key(same: np.ndarray) -> np.ndarray:
    """Of rows of equal-value marks the first key (its index among a signature's) under which such a pair meets, or -1."""
    equal = same.reshape(-1, CHUNKS, WIDTH)
    meets = equal.sum(2) >= WIDTH - ERRORS
    chunk = meets.argmax(1)
    differs = (~equal[np.arange(len(equal)), chunk]).argmax(1)  # the value left out; the first of a wholly equal chunk
    return np.where(meets.any(1), chunk * WIDTH + differs, -1)


MEMBER = "key long, x int, y int, role int, minor boolean, id long, component long, size int, sig binary, bits binary"
BOTH, LEFT, RIGHT = range(3)


class Cells:
    """Rows of members (MEMBER), cell by cell: of a key, or of a block of a key and a block of its minority."""

    def __init__(self, table: pa.Table):
        t = table.combine_chunks()
        self.key, self.x, self.y, self.role, self.id, self.component = (t.column(c).to_numpy() for c in ("key", "x", "y", "role", "id", "component"))
        self.minor = t.column("minor").to_numpy(zero_copy_only=False)
        self.size = t.column("size").to_numpy().astype(np.int64)
        self.sig, self.bits = signature_rows(t.column("sig")), t.column("bits").to_pylist()

    def borders(self) -> np.ndarray:
        """Where cells begin, and the end."""
        n = len(self.key)
        new = np.append(True, (self.key[1:] != self.key[:-1]) | (self.x[1:] != self.x[:-1]) | (self.y[1:] != self.y[:-1]))[:n]
        return np.append(np.flatnonzero(new), n)

    def across(self, s: int, e: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs of rows s to e of different components, whose sizes may go together."""
        left, right = np.flatnonzero(self.role[s:e] != RIGHT) + s, np.flatnonzero(self.role[s:e] != LEFT) + s
        step = max(1, 4 * AT_ONCE // max(1, len(right)))
        for at in range(0, len(left), step):
            i = np.repeat(left[at : at + step], len(right))
            j = np.tile(right, len(left[at : at + step]))
            # where both ends are in both lists, the pair is seen from either
            fit = (self.component[i] != self.component[j]) & ((self.id[i] < self.id[j]) | ((self.role[i] == LEFT) & ~self.minor[i]))
            fit &= 100 * np.minimum(self.size[i], self.size[j]) >= percent * np.maximum(self.size[i], self.size[j])
            yield i[fit], j[fit]

    def candidates(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Marks pairs within DISTANCE that may be alike and that this key is the first to see."""
        same = self.sig[i] == self.sig[j]
        fit = np.flatnonzero(VALUES - same.sum(1) <= DISTANCE)
        key = chunk_keys(self.sig[i[fit]])[np.arange(len(fit)), first_key(same[fit])].view(np.int64)
        fit = fit[key == self.key[i[fit]]]
        a, b = i[fit], j[fit]
        fit = fit[may_link([self.bits[k] for k in a.tolist()], [self.bits[k] for k in b.tolist()], self.size[a], self.size[b], percent)]
        out = np.zeros(len(i), bool)
        out[fit] = True
        return out


def pairs_across(percent: int):
    """(a, b) of candidates; rows come sorted by cell, and a cell that a batch cuts is carried on."""

    def judged(cells: Cells, borders: np.ndarray) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(len(borders) - 1):
            waiting += cells.across(int(borders[k]), int(borders[k + 1]), percent)
            if sum(len(i) for i, _ in waiting) >= AT_ONCE or k == len(borders) - 2:
                i, j = (np.concatenate([w[side] for w in waiting]) for side in (0, 1))
                waiting = []
                for at in range(0, len(i), AT_ONCE):
                    p, q = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
                    fit = cells.candidates(p, q, percent)
                    a, b = cells.id[p[fit]], cells.id[q[fit]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([*rest, b])
            cells = Cells(table)
            borders = cells.borders()
            yield from judged(cells, borders[:-1])
            rest = table.slice(int(borders[-2])).to_batches()
        if rest:
            cells = Cells(pa.Table.from_batches(rest))
            yield from judged(cells, cells.borders())

    return run


def paired(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b; stored) with the columns of both ends from `table`, which lies in buckets of doc_id.

    Of ids that very many pairs start from there is one copy for each HUB pairs, so no task gets them all.
    """
    one = lambda side: table.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
    both = ["a", "b", *[f"{c}_{side}" for c in columns for side in "ab"]]
    hubs = stored(pairs.groupBy("a").count().where(F.col("count") > HUB).select(F.col("a").alias("hub"), F.ceil(F.col("count") / HUB).cast("int").alias("copies")), "near-dup-hubs")
    side = pairs.join(hubs, F.col("a") == F.col("hub"), "left").join(one("b"), "b")
    copied = one("a").join(hubs, F.col("a") == F.col("hub")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("hub", "copies")
    busy = side.where("copies is not null").withColumn("copy", F.pmod(F.hash("b"), "copies")).join(copied, ["a", "copy"])
    return side.where("copies is null").join(one("a"), "a").select(*both).unionByName(busy.select(*both))


def members_apart(met: DataFrame, reps: DataFrame, first: DataFrame) -> DataFrame:
    """MEMBER rows of the keys whose members are in several components; of a small key without its pivot, which has met them all."""
    keys = met.where("key is not null").withColumn("id", F.explode("members")).where("large or id <> least")
    member = keys.join(first, "id", "left").select("key", "block", "blocks", "id", F.coalesce("component", "id").alias("component"))
    member = stored(member, "near-dup-members")
    sides = member.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("blocks").alias("of")).where("low <> high")
    # in a key of several blocks only the minority, all but its most frequent component, is compared with all
    most = member.where("blocks > 1").groupBy("key", "component").count().groupBy("key").agg(F.max(F.struct("count", "component")).alias("top"), F.sum("count").alias("n"))
    apart = stored(sides.select("key").join(most.select("key", F.col("top.component").alias("top"), F.ceil((F.col("n") - F.col("top.count")) / BLOCK).cast("int").alias("few")), "key", "left"), "near-dup-apart")
    chosen = member.join(apart, "key").withColumn("minor", F.coalesce(F.col("component") != F.col("top"), F.lit(False)))
    cell = lambda x, y, role: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(role).alias("role"))
    zero, own = F.lit(0), F.pmod(F.xxhash64("id"), F.greatest("few", F.lit(1)))
    as_left = F.transform(F.sequence(zero, F.col("few") - 1), lambda y: cell(F.col("block"), y, LEFT))
    as_right = F.when(F.col("minor"), F.transform(F.sequence(zero, F.col("blocks") - 1), lambda x: cell(x, own, RIGHT))).otherwise(F.array().cast("array<struct<x:int,y:int,role:int>>"))
    cells = F.explode(F.when(F.col("blocks") == 1, F.array(cell(zero, zero, BOTH))).otherwise(F.concat(as_left, as_right)))
    out = chosen.withColumn("cell", cells).join(reps.withColumnRenamed("doc_id", "id"), "id")
    return out.select("key", "cell.x", "cell.y", "cell.role", "minor", "id", "component", "size", "sig", "bits")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of `docs`.

    Words are runs of bytes other than blanks and controls 9 to 13, with A-Z lower-cased. Texts whose shingle sets
    have 100 * intersection >= percent * union are linked; component_id is the smallest doc_id in reach, and the
    document of that id is kept. Texts without words (null too) and rows with a null doc_id are linked with
    nothing and kept (a null doc_id has a null component_id). Rows that share a
    doc_id are judged each by its own text. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    with passing() as kept:
        base = bucketed(texts(docs), "doc_id", "near_dup_texts")
        feat = stored(base.mapInArrow(digests(n), "doc_id long, n_shingles long, d1 long, d2 long"), "near-dup-digests")
        real = feat.where("n_shingles > 0 and doc_id is not null")
        classes = stored(real.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep")), "near-dup-classes")
        asked = base.join(classes.withColumnRenamed("rep", "doc_id"), "doc_id").mapInArrow(sketches(n), "doc_id long, size int, sig binary, bits binary")
        reps = bucketed(asked, "doc_id", "near_dup_sketches", aligned=True)

        dealt = reps.select("doc_id", "sig").mapInArrow(spread(slots(spark)), packed.schema(PLANES)).repartition(tasks(spark), "slot")
        met = stored(dealt.mapInArrow(meet, MET), "near-dup-keys")

        def linked(pairs: DataFrame) -> DataFrame:
            found = stored(paired(pairs, base, ["text"]).mapInArrow(verify(n, percent), "a long, b long").distinct(), "near-dup-links")
            drop(pairs)
            return found

        stars = stored(met.where("key is null").select(F.explode(F.arrays_zip("members", "pivots")).alias("x")).select(F.col("x.pivots").alias("a"), F.col("x.members").alias("b")).distinct(), "near-dup-stars")
        links = linked(stored(paired(stars, reps, ["size", "sig", "bits"]).mapInArrow(near(percent), "a long, b long"), "near-dup-near"))
        drop(stars)
        first = connected(links)

        # Keys whose members are still in several components: pairs across are looked at where the key's members meet.
        left = members_apart(met, reps, first).repartition(tasks(spark), "key", "x", "y").sortWithinPartitions("key", "x", "y", "id")
        more = linked(stored(left.mapInArrow(pairs_across(percent), "a long, b long").distinct(), "near-dup-across"))
        stars_so_far = first.select(F.col("id").alias("a"), F.col("component").alias("b"))
        final = connected(stars_so_far.unionByName(more))

        of_rep = classes.join(final.select(F.col("id").alias("rep"), "component"), "rep", "left").select("n_shingles", "d1", "d2", F.coalesce("component", "rep").alias("component"))
        of_rep = stored(of_rep, "near-dup-class-components")
        kept += [feat, of_rep]
    out = feat.join(of_rep, ["n_shingles", "d1", "d2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that `near_duplicates` keeps; all columns stay, in their order."""
    gone = stored(near_duplicates(docs, n, percent).where("not kept").select("doc_id").distinct(), "near-dup-gone")
    return docs.join(gone.withColumnRenamed("doc_id", "gone_id"), F.col("doc_id").cast("long") == F.col("gone_id"), "left_anti")
