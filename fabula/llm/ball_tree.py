"""A ball tree over rows of whole numbers, and the search for the best inner products in a window of scores.

A node's ball bounds what its rows score with a query q: q.centre + |q| radius above, q.centre - |q| radius below. The
topmost nodes divide the rows by their labels, so most nodes hold one label; below that, rows part along the line
between two that lie far from each other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from fabula.llm.vectors import exact

LEAF = 32
LEAST, MOST = -(2**62), 2**62
#: Share of a bound by which it is widened, far above what rounding of doubles can amount to.
SLACK = 1e-9


@dataclass
class Tree:
    """Rows in the order of the leaves, and the nodes by level; the children of node i are left[i] and left[i] + 1."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    label_low: np.ndarray
    label_high: np.ndarray
    least_id: np.ndarray

    KINDS = {"ids": np.int64, "labels": np.int64, "x": np.int64, "start": np.int64, "end": np.int64, "left": np.int64, "centre": np.float64, "radius": np.float64, "label_low": np.int64, "label_high": np.int64, "least_id": np.int64}

    def packed(self) -> dict[str, bytes]:
        return {n: np.ascontiguousarray(getattr(self, n), kind).tobytes() for n, kind in self.KINDS.items()}

    @classmethod
    def unpacked(cls, packed: dict[str, bytes]) -> Tree:
        got = {n: np.frombuffer(packed[n], kind) for n, kind in cls.KINDS.items()}
        return cls(**got | {"x": got["x"].reshape(len(got["ids"]), -1), "centre": got["centre"].reshape(len(got["start"]), -1)})


def _halves(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, int]:
    """An order of a node's rows, and where its second child begins in it."""
    n = len(ids)
    if labels.min() < labels.max():
        order = np.argsort(labels, kind="stable")
        cuts = np.flatnonzero(np.diff(labels[order])) + 1
        return order, int(cuts[np.abs(cuts - n // 2).argmin()])
    a = x[((x - centre) ** 2).sum(1).argmax()]
    b = x[((x - a) ** 2).sum(1).argmax()]
    return np.lexsort((ids, x @ (b - a))), n // 2


def build(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> Tree:
    order, y = np.arange(len(ids)), x.astype(np.float64)
    spans, nodes = [(0, len(ids))] if len(ids) else [], []
    for s, e in spans:  # grows as it goes: nodes come level by level
        at = order[s:e]
        centre = y[at].mean(0)
        radius = float(np.sqrt(((y[at] - centre) ** 2).sum(1).max()))
        left = -1
        if e - s > leaf:
            by, cut = _halves(y[at], ids[at], labels[at], centre)
            order[s:e] = at[by]
            left = len(spans)
            spans += [(s, s + cut), (s + cut, e)]
        nodes.append((s, e, left, centre, radius, labels[at].min(), labels[at].max(), ids[at].min()))
    column = lambda i, kind: np.array([n[i] for n in nodes], kind)
    centres = np.stack([n[3] for n in nodes]) if nodes else np.zeros((0, x.shape[1]))
    return Tree(ids[order], labels[order], x[order], column(0, np.int64), column(1, np.int64), column(2, np.int64), centres, column(4, np.float64), column(5, np.int64), column(6, np.int64), column(7, np.int64))


@dataclass
class Asked:
    """Queries, and the best answers so far: `scores` and `ids`, k a query, best first; LEAST where none is yet."""

    own: np.ndarray
    labels: np.ndarray
    low: np.ndarray
    high: np.ndarray
    x: np.ndarray
    scores: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, own: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray, k: int) -> Asked:
        return cls(own, labels, low, high, x, np.full((len(own), k), LEAST), np.full((len(own), k), MOST))


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def search(tree: Tree, asked: Asked, same_label: bool) -> int:
    """Takes what the tree's rows add to the queries' best answers, and returns how many scores were computed.

    An answer has another id than the query, its label (or another one, unless `same_label`) and a score from `low` to
    `high`. A node is left out where its bounds miss that window, or are beneath the k-th answer so far; at a score equal
    to that one, where all its ids are larger.
    """
    if not len(tree.start) or not len(asked.own):
        return 0
    width = max(tree.x.shape[1], asked.x.shape[1])
    x, q, centre = _widened(tree.x, width), _widened(asked.x, width), _widened(tree.centre, width)
    kind = exact(x, q)
    x, q, floats = x.astype(kind), q.astype(kind), q.astype(np.float64)
    length, size = np.sqrt((floats**2).sum(1)), np.sqrt((centre**2).sum(1)) + tree.radius
    top, bottom = np.full((len(q), len(centre)), -np.inf), np.full((len(q), len(centre)), np.inf)

    def still(queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Of queries x nodes, where the bounds leave room for an answer."""
        grid = np.ix_(queries, nodes)
        worst, worst_id = asked.scores[queries, -1][:, None], asked.ids[queries, -1][:, None]
        room = (top[grid] >= asked.low[queries][:, None]) & (bottom[grid] <= asked.high[queries][:, None])
        room &= (top[grid] > worst) | ((top[grid] == worst) & (tree.least_id[nodes] < worst_id))
        low, high, label = tree.label_low[nodes], tree.label_high[nodes], asked.labels[queries][:, None]
        return room & ((low <= label) & (label <= high) if same_label else (low < high) | (low != label))

    def bound(queries: np.ndarray, nodes: np.ndarray) -> None:
        """Scores are whole numbers, so the bounds are, too."""
        grid = np.ix_(queries, nodes)
        middle, spread = floats[queries] @ centre[nodes].T, length[queries][:, None] * (tree.radius[nodes] + SLACK * size[nodes])
        top[grid] = np.clip(np.floor(middle + spread + SLACK), LEAST, MOST)
        bottom[grid] = np.clip(np.ceil(middle - spread - SLACK), LEAST, MOST)

    level, alive = np.array([0]), np.zeros((len(q), len(centre)), bool)
    reach = np.ones((len(q), 1), bool)
    while len(level):
        queries = np.flatnonzero(reach.any(1))
        bound(queries, level)
        reach[queries] &= still(queries, level)
        reach[np.setdiff1d(np.arange(len(q)), queries)] = False
        alive[:, level] = reach
        inner = np.flatnonzero((tree.left[level] >= 0) & reach.any(0))
        reach = np.repeat(reach[:, inner], 2, axis=1)
        level = (tree.left[level[inner]][:, None] + np.arange(2)).ravel()
    leaves = np.flatnonzero((tree.left < 0) & alive.any(0))
    done, scored = np.zeros((len(q), len(leaves)), bool), 0

    def score(queries: np.ndarray, leaf: int) -> int:
        s, e = tree.start[leaf], tree.end[leaf]
        got = (q[queries] @ x[s:e].T).astype(np.int64)
        fit = (got >= asked.low[queries][:, None]) & (got <= asked.high[queries][:, None]) & (tree.ids[s:e] != asked.own[queries][:, None])
        fit &= (tree.labels[s:e] == asked.labels[queries][:, None]) == same_label
        fit &= got >= asked.scores[queries, -1][:, None]
        some = np.flatnonzero(fit.any(1))
        if len(some):
            k, at = asked.scores.shape[1], queries[some]
            scores = np.concatenate([asked.scores[at], np.where(fit[some], got[some], LEAST)], axis=1)
            ids = np.concatenate([asked.ids[at], np.where(fit[some], tree.ids[s:e], MOST)], axis=1)
            best = np.lexsort((ids, -scores), axis=1)[:, :k]
            asked.scores[at], asked.ids[at] = np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)
        return got.size

    if len(leaves):
        # first each query's most promising leaf, which gives a k-th score to prune the others by
        hope = np.where(alive[:, leaves], np.minimum(top[:, leaves], asked.high[:, None]), -np.inf)
        first = hope.argmax(1)
        for i in np.unique(first).tolist():
            queries = np.flatnonzero((first == i) & alive[:, leaves[i]])
            if len(queries):
                scored += score(queries, leaves[i])
                done[queries, i] = True
        for i in np.argsort(-hope.max(0), kind="stable").tolist():
            queries = np.flatnonzero(alive[:, leaves[i]] & ~done[:, i])
            queries = queries[still(queries, leaves[i : i + 1])[:, 0]]
            if len(queries):
                scored += score(queries, leaves[i])
    return scored
