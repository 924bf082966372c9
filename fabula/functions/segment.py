"""Words of texts that are written without spaces: a dictionary trie, and the likeliest path through each run.

All runs of a batch go together: the trie is walked from all their characters at once, and the paths are found from the
runs' ends in lock-step, so that the loops are over characters of a word and of a run, not over words and rows.
"""

from __future__ import annotations

import math
from collections.abc import Container, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import regex

#: Characters that are written without spaces between words: CJK ideographs.
HAN = "㐀-䶿一-鿿"
RUN = regex.compile(f"[{HAN}]+")
#: A stretch of other letters.
WHOLE = regex.compile(rf"(?:(?![{HAN}])\p{{L}})+")
#: Letters, in stretches of ideographs and of others.
TOKEN = regex.compile(rf"[{HAN}]+|(?:(?![{HAN}])\p{{L}})+")
#: Characters of runs that are worked on at once.
AT_ONCE = 1 << 17


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


@dataclass
class Trie:
    """Words by their characters. `keys` are (node, character) pairs in order; the node that one leads to is its place plus one."""

    keys: np.ndarray
    word: np.ndarray
    weight: np.ndarray
    longest: int

    @classmethod
    def of(cls, words: list[str], weights: list[float]) -> Trie:
        size = np.array([len(w) for w in words], np.int64)
        longest = int(size.max(initial=0))
        letters = np.full((len(words), longest), -1, np.int64)
        for i, w in enumerate(words):
            letters[i, : len(w)] = codes(w)
        node, levels, ends, made = np.zeros(len(words), np.int64), [], {}, 1
        for d in range(longest):
            at = np.flatnonzero(size > d)
            found, child = np.unique(node[at] << 21 | letters[at, d], return_inverse=True)
            levels.append(found)
            node[at] = made + child
            made += len(found)
            ends |= {int(node[i]): int(i) for i in np.flatnonzero(size == d + 1)}
        word = np.full(made, -1, np.int64)
        for n, i in ends.items():
            word[n] = i
        # nodes are numbered level by level, so keys of later levels are greater: all are in order
        return cls(np.concatenate(levels) if levels else np.zeros(0, np.int64), word, np.array([*weights, -math.inf]), longest)

    def found(self, text: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Of each place and length (from 1) the word that stands there, or -1; `room` is how many characters its run has from there."""
        out = np.full((len(text), self.longest), -1, np.int64)
        at, node = np.arange(len(text)), np.zeros(len(text), np.int64)
        for d in range(self.longest):
            fits = room[at] > d
            at, node = at[fits], node[fits]
            key = node << 21 | text[at + d]
            place = np.searchsorted(self.keys, key)
            hit = place < len(self.keys)
            hit[hit] = self.keys[place[hit]] == key[hit]
            at, node = at[hit], place[hit] + 1
            if not len(at):
                break
            out[at, d] = self.word[node]
        return out


@dataclass
class Words:
    """A dictionary: words with their frequencies. A word of a frequency below one counts as of one."""

    base: Trie
    total: float
    own: dict[object, Trie] = field(default_factory=dict)

    @classmethod
    def of(cls, words: Iterable[tuple[str, float | None]]) -> Words:
        """Of a word that is given twice the last frequency counts; without one it is 1."""
        freq = {w: max(float(f or 1), 1.0) for w, f in words if w}
        total = max(sum(freq.values()), 1.0)
        return cls(Trie.of(list(freq), [math.log(f / total) for f in freq.values()]), total)

    def add(self, scope: object, words: Iterable[tuple[str, float | None]]) -> None:
        """A scope's own words, which no other scope has. One without a frequency is a little likelier than what it would be cut into."""
        freq = {w: f for w, f in words if w}
        bare = [w for w, f in freq.items() if f is None]
        parts = dict(zip(bare, self._paths(bare, None)[1]))
        weights = [math.log(max(f, 1.0) / self.total) if f is not None else parts[w] + 1e-9 * (1 + abs(parts[w])) for w, f in freq.items()]
        self.own[scope] = Trie.of(list(freq), weights)

    def keep(self, scopes: Container[object]) -> None:
        """Forgets the own words of other scopes."""
        for s in [s for s in self.own if s not in scopes]:
            del self.own[s]

    def _paths(self, runs: list[str], scope: object) -> tuple[list[np.ndarray], list[float]]:
        """Of each run where its words begin, and the sum of their weights.

        The sum is greatest; of two paths with one sum, that with the longer word where they part. A character that is no
        word counts as one of frequency 1.
        """
        size = np.array([len(r) for r in runs], np.int64)
        text = codes("".join(runs))
        end = np.cumsum(size)
        room = np.repeat(end, size) - np.arange(len(text))
        tries = [self.base, *([self.own[scope]] if scope in self.own else [])]
        longest = max([1, *[t.longest for t in tries]])
        weight = np.full((len(text), longest), -np.inf)
        weight[:, 0] = -math.log(self.total)
        for t in tries:  # the scope's own words last: their weights count
            word = t.found(text, room)
            np.copyto(weight[:, : t.longest], t.weight[word], where=word >= 0)
        run = np.repeat(np.arange(len(runs)), size)
        best, step = np.zeros(len(text) + len(runs)), np.ones(len(text), np.int64)  # a run has one sum more than characters: that of its end
        order = np.argsort(-size, kind="stable")
        longer = len(runs) - np.searchsorted(np.sort(size), np.arange(1, int(size.max(initial=0)) + 1))
        reach = np.arange(1, longest + 1)
        for back, n in enumerate(longer.tolist(), 1):
            at = end[order[:n]] - back
            slot = at + run[at]
            sums = weight[at] + best[np.minimum(slot[:, None] + reach, len(best) - 1)]
            step[at] = longest - np.argmax(sums[:, ::-1], axis=1)
            best[slot] = sums[np.arange(n), step[at] - 1]
        begins, at = np.zeros(len(text), bool), (end - size)[size > 0]
        stop = end[size > 0]
        while len(at):
            begins[at] = True
            at = at + step[at]
            at, stop = at[at < stop], stop[at < stop]
        starts = np.split(np.flatnonzero(begins), np.cumsum(np.bincount(run[begins], minlength=len(runs)))[:-1]) if len(runs) else []
        first = end - size
        return [s - f for s, f in zip(starts, first)], [float(best[f + i]) if n else 0.0 for i, (f, n) in enumerate(zip(first.tolist(), size.tolist()))]

    def cut(self, runs: list[str], scope: object = None) -> Iterator[list[str]]:
        """The words of each run."""
        for i, j in _blocks([len(r) for r in runs]):
            for r, starts in zip(runs[i:j], self._paths(runs[i:j], scope)[0]):
                stops = [*starts[1:].tolist(), len(r)]
                yield [r[a:b] for a, b in zip(starts.tolist(), stops)]

    def tokens(self, texts: list[str], scope: object = None) -> list[list[tuple[str, int]]]:
        """The tokens of each text with their places: words of runs, and stretches of other letters."""
        spans = [[(m.group(), m.start()) for m in TOKEN.finditer(t)] for t in texts]
        words = self.cut([s for own in spans for s, _ in own if RUN.match(s)], scope)
        out = []
        for own in spans:
            found: list[tuple[str, int]] = []
            for s, at in own:
                for w in next(words) if RUN.match(s) else [s]:
                    found.append((w, at))
                    at += len(w)
            out.append(found)
        return out


def _blocks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of about AT_ONCE characters together."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= AT_ONCE:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)
