"""Byte-level BPE: encoding by numpy matrices of pieces, decoding by vocabulary bytes.

Texts are split by the tokenizer's pattern. The distinct pieces that a task has not met are grouped by length
into padded matrices; each round merges, in every row, the leftmost pair of least rank, found in a hash table of
pairs, and closes the gap. A piece too long for a matrix takes its leftmost pair of least rank from a heap instead, so
its time grows with its length and not with the square of it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fabula.llm.shared import texts
from fabula.llm.textkit import parts

NONE = np.int32(2**31 - 1)
LONG_PIECE = 256
ROWS_AT_ONCE = 4096
#: Pieces that a task remembers before it starts anew.
REMEMBERED = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 of the bytes, blank, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Ranks of pairs of ids in an open-addressed hash table of arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (2 * len(pairs)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        left = np.array([(a << 32) | b for a, b in pairs], np.int64)
        rank = np.array(list(pairs.values()), np.int32)
        slot = self._slot(left)
        while len(left):  # each pass fills the free slots, one key each; the others go on to the next slot
            free = np.flatnonzero(self.keys[slot] == -1)
            self.keys[slot[free]] = left[free]
            self.ranks[slot[free]] = rank[free]
            rest = self.keys[slot] != left
            left, rank, slot = left[rest], rank[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
        # a slot written twice in a pass keeps the last key, and its rank was written by the same row

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where there is no merge (or an id is negative)."""
        shape = left.shape
        a, b = left.ravel().astype(np.int64), right.ravel().astype(np.int64)
        keys = (a << 32) | b
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        slot = self._slot(keys[todo])
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there != -1)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.split = regex.compile(pattern).findall
        self.pair_ranks: dict[int, int] = {}
        self.pairs = PairTable({(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks})

    def merge_matrix(self, rows: list[bytes]) -> list[list[int]]:
        """Ids of pieces of like lengths, by rounds over a padded matrix."""
        width = max(map(len, rows))
        m = np.full((len(rows), width + 1), -1, np.int32)
        lens = np.array([len(r) for r in rows])
        m[np.arange(width + 1) < lens[:, None]] = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        rank = self.pairs.lookup(m[:, :-1], m[:, 1:])
        out, live = m.copy(), np.arange(len(rows))
        while len(live):
            at = rank.argmin(1)  # the leftmost of the least
            best = rank[np.arange(len(live)), at]
            done = best == NONE
            if done.any():
                out[live[done], : m.shape[1]] = m[done]
                out[live[done], m.shape[1] :] = -1
                keep = ~done
                live, m, rank, at, best = live[keep], m[keep], rank[keep], at[keep], best[keep]
                if not len(live):
                    break
            i = np.arange(len(live))
            cols = np.arange(m.shape[1] - 1)
            m[i, at] = best  # a token's id is its rank
            m = np.take_along_axis(m, cols + (cols > at[:, None]), 1)
            if m.shape[1] < 2:
                m = np.pad(m, ((0, 0), (0, 1)), constant_values=-1)
                rank = np.full((len(live), 1), NONE, np.int32)
                continue
            cols = cols[:-1]
            rank = np.take_along_axis(rank, cols + (cols > at[:, None]), 1)
            left = np.maximum(at - 1, 0)
            here = np.minimum(at, rank.shape[1] - 1)
            rank[i, left] = self.pairs.lookup(m[i, left], m[i, left + 1])
            rank[i, here] = self.pairs.lookup(m[i, here], m[i, here + 1])
        return [r[r >= 0].tolist() for r in out]

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one long piece: a heap holds (rank, place) of its pairs; one that has changed since is passed over."""
        if not self.pair_ranks:
            taken = self.pairs.keys >= 0
            self.pair_ranks = dict(zip(self.pairs.keys[taken].tolist(), self.pairs.ranks[taken].tolist(), strict=True))
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, rank_of = len(ids), self.pair_ranks.get
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, r in enumerate(self.pairs.lookup(np.array(ids[:-1]), np.array(ids[1:])).tolist()) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i] if ids[i] >= 0 else n
            if j >= n or rank_of(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = after = nxt[j]
            if after < n:
                prv[after] = i
                if (new := rank_of(r << 32 | ids[after])) is not None:
                    heapq.heappush(heap, (new, i))
            before = prv[i]
            if before >= 0 and (new := rank_of(ids[before] << 32 | r)) is not None:
                heapq.heappush(heap, (new, before))
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece: its own id where the whole piece is a token, else by merges."""
        out: list[list[int] | None] = [[self.ranks[p]] if p in self.ranks else None for p in pieces]
        rest = sorted((i for i, x in enumerate(out) if x is None), key=lambda i: len(pieces[i]))
        at = 0
        while at < len(rest):
            size = len(pieces[rest[at]])
            if size > LONG_PIECE:
                out[rest[at]] = self.merge_long(pieces[rest[at]])
                at += 1
                continue
            end = at
            while end < len(rest) and end - at < ROWS_AT_ONCE and len(pieces[rest[end]]) <= size + size // 8:
                end += 1
            for i, ids in zip(rest[at:end], self.merge_matrix([pieces[i] for i in rest[at:end]]), strict=True):
                out[i] = ids
            at = end
        return out  # type: ignore[return-value]

    def encode(self, text: str) -> list[int]:
        pieces = [p.encode("utf-8", "surrogatepass") for p in self.split(text)]
        return [i for ids in self.encode_pieces(pieces) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and `ids` where `keep_ids`) for each row of `docs`.

    A map over partitions: nothing is shuffled, and a task holds one batch of texts, its pieces, and at most
    REMEMBERED pieces' ids. Null text is empty: no tokens, digests of the empty string. Repeated rows give
    repeated rows; null ids stay null; an empty table gives none.
    """
    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(load_ranks(ranks_path), pattern)
        known: dict[str, tuple[str, int, bytes, list[int]]] = {}
        for b in parts(batches):
            split = [bpe.split(t) for t in b.column("text").to_pylist()]
            if len(known) > REMEMBERED:
                known.clear()
            new = [p for p in {p for ps in split for p in ps} if p not in known]
            for p, ids in zip(new, bpe.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new]), strict=True):
                known[p] = (",".join(map(str, ids)), len(ids), bpe.decode(ids), ids)
            n, ids_hex, text_hex, lists = [], [], [], []
            for ps in split:
                found = [known[p] for p in ps]
                n.append(sum([x[1] for x in found]))
                ids_hex.append(hashlib.sha256(",".join([x[0] for x in found]).encode()).hexdigest())
                text_hex.append(hashlib.sha256(b"".join([x[2] for x in found])).hexdigest())
                if keep_ids:
                    lists.append([i for x in found for i in x[3]])
            arrays = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return texts(docs).mapInArrow(run, columns)


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids array<int>); null ids give empty text, bytes that are not UTF-8 are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {v: k for k, v in load_ranks(ranks_path).items()}
        for b in batches:
            out = [b"".join([words[i] for i in ids or ()]).decode("utf-8", "replace") for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
