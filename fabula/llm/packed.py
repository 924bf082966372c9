"""Columns of numbers dealt to slots by a hash, packed to a few binary rows for each task and slot."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCHEMA = "slot int, {}"


def schema(planes: dict[str, type]) -> str:
    return "slot int, " + ", ".join(f"{n} binary" for n in planes)


def deal(slots: list[int], by: np.ndarray, planes: dict[str, np.ndarray], names: Iterable[str] | None = None) -> pa.RecordBatch:
    """A row for each slot that gets entries; `by` (hashes) chooses the slot. Entries keep their order.

    `names` are the planes of the rows, where they have more than these entries: the others are empty.
    """
    where = (by >> np.uint64(20)) % np.uint64(len(slots))
    order = np.argsort(where.astype(np.uint32), kind="stable")
    own, start = np.unique(where[order], return_index=True)
    ends = np.append(start[1:], len(order))
    out = {n: planes[n][order] if n in planes else None for n in names or planes}
    cuts = list(zip(start.tolist(), ends.tolist(), strict=True))
    return pa.RecordBatch.from_arrays([pa.array([slots[int(i)] for i in own], pa.int32()), *[pa.array([b"" if x is None else x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in out.values()]], names=["slot", *out])


def settled(batches: Iterable[pa.RecordBatch], key: str, planes: Iterable[str], others: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The given planes of the rows whose plane `key` is empty, as they come; the other rows are put on the list."""
    for b in batches:
        done = pc.equal(pc.binary_length(b.column(key)), 0)
        rows = b.filter(done)
        if rows.num_rows:
            yield pa.RecordBatch.from_arrays([rows.column("slot"), *[rows.column(n).cast(pa.binary()) for n in planes]], names=["slot", *planes])
        rows = b.filter(pc.invert(done))
        if rows.num_rows:
            others.append(rows)


def gather(batches: Iterator[pa.RecordBatch], planes: dict[str, type]) -> dict[str, np.ndarray]:
    """All entries that a task was dealt."""
    got: dict[str, list[np.ndarray]] = {n: [] for n in planes}
    for b in batches:
        for n, kind in planes.items():
            got[n] += [np.frombuffer(x, kind) for x in b.column(n).to_pylist()]
    return {n: np.concatenate(got[n]) if got[n] else np.zeros(0, kind) for n, kind in planes.items()}


def lists_by(ids: np.ndarray, planes: dict[str, np.ndarray], at_once: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n, binary planes) of the entries of each id."""
    order = np.argsort(ids, kind="stable")
    own, start = np.unique(ids[order], return_index=True)
    ends = np.append(start[1:], len(order))
    out = {n: x[order] for n, x in planes.items()}
    for i in range(0, len(own), at_once):
        cut = list(zip(start[i : i + at_once].tolist(), ends[i : i + at_once].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(own[i : i + at_once].astype(np.int64)), *[pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in out.values()]], names=["doc_id", *out])
