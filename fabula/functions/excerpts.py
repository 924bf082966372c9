"""Excerpts around places in a text, as intervals that do not touch."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

GAP = "\n……\n"
#: Where a text that is too long is cut: before the last of the first of these that it holds.
ENDS = "。！？"


def spread(hits: list[int], length: int, before: int, after: int, limit: int, parts: int = 4) -> list[tuple[int, int]]:
    """Windows (start, stop) around hits, up to about `limit` together, each part of the text giving its share.

    In each part windows are taken from the left, each at the nearest hit whose window does not touch the last one's,
    until they reach `limit / parts`; later parts give nothing once all that was taken reaches `limit`.
    """
    taken: list[tuple[int, int]] = []
    for p in range(parts):
        if sum(b - a for a, b in taken) >= limit:
            break
        stop = bisect_left(hits, int(length * (p + 1) / parts)) if p + 1 < parts else len(hits)
        at = bisect_left(hits, int(length * p / parts))
        own: list[tuple[int, int]] = []
        while True:
            if taken or own:
                at = max(at, bisect_right(hits, (own or taken)[-1][1] + before))
            if at >= stop or own and sum(b - a for a, b in own) >= limit // parts:
                break
            own.append((max(0, hits[at] - before), min(length, hits[at] + after)))
        taken += own
    return taken


def shortened(text: str, limit: int) -> str:
    """A text of at most `limit` characters."""
    if len(text) <= limit:
        return text
    ends = (text.rfind(e, 0, limit) for e in ENDS)
    return text[: next((at for at in ends if at >= 0), limit)]


def around(text: str, hits: list[int], before: int, after: int, limit: int) -> str:
    """What stands around sorted hits; without any, the text's beginning."""
    if not hits:
        return text[:limit]
    return shortened(GAP.join(text[a:b] for a, b in spread(hits, len(text), before, after, limit)), limit)


def around_both(text: str, first: str, firsts: list[int], second: str, seconds: list[int], before: int, after: int, limit: int) -> str:
    """Windows around the places of one name that hold another whole, until they reach `limit`; without any, the first window.

    `firsts` and `seconds` are all places of the names, sorted; of the first name those count that do not overlap.
    """
    held, size, free, whole = [], 0, 0, None
    for at in firsts:
        if at < free:
            continue
        free = at + len(first)
        start, stop = max(0, at - before), min(len(text), at + after)
        whole = whole or (start, stop)
        nearest = bisect_left(seconds, start)
        if nearest < len(seconds) and seconds[nearest] + len(second) <= stop:
            held.append(text[start:stop])
            size += stop - start
            if size >= limit:
                break
    return GAP.join(held)[:limit] if held else text[whole[0] : whole[1]]
