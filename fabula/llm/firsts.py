"""Reducing what a task sends before it is dealt: of a key that very many entries share, the task sends the earliest ones only.

An entry that has an earlier one with its key in its own task is no first of that key anywhere, so it is settled there
and goes straight to its document. The place that holds a key's entries so gets a few from each task, not all of them.
"""

from __future__ import annotations

import numpy as np

#: Keys and seeds that a task remembers from batch to batch. What it forgets is sent once more; no result depends on it.
REMEMBERED = 1 << 14
#: Different spans of one seed that a task sends to the seed's slot; two are enough to show there that it has several.
SPANS = 16


class Firsts:
    """The earliest place (doc, start) of each key, as far as a task has seen."""

    def __init__(self, same_doc: bool, remembered: int = REMEMBERED):
        self.same_doc, self.remembered = same_doc, remembered
        self.high, self.low = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.docs, self.starts = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def judge(self, high: np.ndarray, low: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each entry repeats one that the task sends or has sent, and that one's doc and start.

        With `same_doc` an earlier start in the same document counts; without it, only a smaller document does.
        """
        known = len(self.docs)
        h, w = np.concatenate([self.high, high]), np.concatenate([self.low, low])
        d, s = np.concatenate([self.docs, docs]), np.concatenate([self.starts, starts])
        if not len(d):
            return np.zeros(0, bool), docs, starts
        order = np.lexsort((s, d, w, h))
        h_in, w_in = h[order], w[order]
        new = np.append(True, (h_in[1:] != h_in[:-1]) | (w_in[1:] != w_in[:-1]))
        first, group = order[new], np.cumsum(new) - 1
        head = np.empty(len(d), np.int64)
        head[order] = first[group]
        again = (d != d[head]) | ((s != s[head]) if self.same_doc else False)
        most = np.argsort(-np.bincount(group), kind="stable")[: self.remembered]
        keep = first[most]
        of = head[known:]
        out = again[known:], d[of], s[of]
        self.high, self.low, self.docs, self.starts = h[keep], w[keep], d[keep], s[keep]
        return out


class Wide:
    """Seeds of which a task has sent so many spans that their slot knows of several without any more."""

    def __init__(self, spans: int = SPANS, remembered: int = REMEMBERED):
        self.spans, self.remembered = spans, remembered
        self.seeds, self.span, self.others = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def beyond(self, seeds: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Which entries need not go to the seed's slot, as one span and `spans` entries of others went there before.

        The windows of such entries are looked at one by one, as those are that the slot knows of.
        """
        known = len(self.seeds)
        order = np.argsort(np.concatenate([self.seeds, seeds]), kind="stable")
        a, b = np.concatenate([self.seeds, seeds])[order], np.concatenate([self.span, spans])[order]
        if not len(a):
            return np.zeros(0, bool)
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        size = np.diff(np.append(first, len(a)))
        base = np.concatenate([self.others, np.zeros(len(seeds), np.int64)])[order[first]]
        other = (b != np.repeat(b[first], size)).astype(np.int64)
        before = np.cumsum(other) - other
        before += np.repeat(base - before[first], size)
        out = np.empty(len(a), bool)
        out[order] = before >= self.spans
        others = np.minimum(base + np.add.reduceat(other, first), self.spans)
        keep = np.argsort(-others, kind="stable")[: self.remembered]
        self.seeds, self.span, self.others = a[first][keep], b[first][keep], others[keep]
        return out[known:]
