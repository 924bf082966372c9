"""Vectorised text work on Arrow columns: words, rolling hashes, windows. All of it runs inside tasks.

A batch's texts are one byte array with offsets; words of all its rows are found at once. Byte ranges such as
words and lines are hashed eight bytes at a time by a mixing that is not linear. Hashes of sequences of such hashes,
and of short strings at every place, are polynomials modulo 2**64, so that the hash of any slice is the difference of
two prefix sums times a power; a finaliser spreads the bits. Polynomials are for fewer than SAFE units: from there on
there are sequences (Thue-Morse) that collide whatever the base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BATCH_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that separate words: space and the controls 9 to 13.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, 9, 10, 11, 12, 13]] = False

#: Word bytes after lower-casing: digits, a to z, and all beyond ASCII.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = True
ALNUM_WORDS[0x61:0x7B] = True
ALNUM_WORDS[0x80:] = True

_RNG = np.random.Generator(np.random.PCG64(20240607))
CODES = _RNG.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
SAFE = 1024
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16, 0 if have is None else 2 * len(have[0]))
        base = BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[which] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


def prefix(codes: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums from which `slices` takes the hash of any slice of `codes`."""
    p = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(which, len(codes))[0], out=p[1:], dtype=np.uint64)
    return p


def slices(p: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the slices [start, end)."""
    return mix((p[ends] - p[starts]) * powers(which, len(p))[1][starts])


#: By number of bytes (up to 8): the mask of a little-endian value's first bytes.
FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges of any length; `which` chooses one of two independent functions.

    Every eight bytes are mixed with their place in the range, and the results are summed.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(SEEDS[which]))
    pieces = (size + 7) >> 3
    total = int(pieces.sum())
    if not total:
        return out
    first = np.cumsum(pieces) - pieces
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    at_once = 1 << 20
    sums = np.zeros(total + 1, np.uint64)
    owner = np.repeat(np.arange(len(size)), pieces)
    for i in range(0, total, at_once):
        own = owner[i : i + at_once]
        nth = np.arange(i, i + len(own)) - first[own]
        at = starts[own] + 8 * nth
        x = np.ascontiguousarray(view[at]).view("<u8").ravel() & FIRST_BYTES[np.minimum(ends[own] - at, 8)]
        place = mix(nth.astype(np.uint64) * np.uint64(BASES[1]) + np.uint64(SEEDS[which]))
        sums[i + 1 : i + 1 + len(own)] = mix(x ^ place)
    np.cumsum(sums, out=sums, dtype=np.uint64)
    return mix(out ^ (sums[first + pieces] - sums[first]))


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, at_once: int = 1 << 21) -> np.ndarray:
    """Whether the ranges of `size` bytes that begin at `a` and at `b` are equal, pair by pair."""
    out = np.ones(len(a), bool)
    ends = np.cumsum(size)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + at_once, side="right")))
        n = size[i:j]
        own = np.repeat(np.arange(i, j), n)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        out[own[data[a[own] + nth] != data[b[own] + nth]]] = False
        i = j
    return out


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and the offsets of rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def parts(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about `limit` bytes of text, and of at most `rows` rows (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
            j = j if rows is None else min(j, i + rows)
            yield batch.slice(i, j - i)
            i = j


class Words:
    """Words of a batch: byte ranges, the row of each, and where each row's words begin and end."""

    def __init__(self, data: np.ndarray, off: np.ndarray, word_bytes: np.ndarray):
        inside = word_bytes[data]
        first, last = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        first[off] = last[off] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | first[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | last[1:-1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.row_at = np.searchsorted(self.starts, off)
        self.counts = np.diff(self.row_at)
        self.data = data

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        return range_hashes(self.data, self.starts, self.ends, which)

    def collide(self, hashes: np.ndarray) -> bool:
        """Whether two different words have one hash: equal hashes are checked byte by byte."""
        order = np.argsort(hashes, kind="stable")
        a, b = order[:-1], order[1:]
        met = hashes[a] == hashes[b]
        a, b = a[met], b[met]
        size = self.ends - self.starts
        return bool((size[a] != size[b]).any()) or not same_bytes(self.data, self.starts[a], self.starts[b], size[a]).all()

    def joined(self, i: int, j: int, sep: bytes = b" ") -> bytes:
        return sep.join(self.data[a:b].tobytes() for a, b in zip(self.starts[i:j].tolist(), self.ends[i:j].tolist(), strict=True))


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def find_sorted(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The index of each key in the sorted `table`, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


class Lookup:
    """Finds hashes in a small set: a bit per low 16 bits sorts out most of what is not there."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `hashes` that hold a key, and the index of that key."""
        at = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        found = find_sorted(hashes[at], self.keys)
        return at[found >= 0], self.order[found[found >= 0]]


def hash_of(words: list[bytes]) -> np.ndarray:
    """The hash that `Words.hashes` gives each of these words."""
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) for w in words])
    raw = np.frombuffer(b"".join(words), np.uint8)
    return range_hashes(raw, np.concatenate(([0], ends[:-1])), ends)
