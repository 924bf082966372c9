"""Plain, quadratic or in-memory versions of the operators, for small tables."""

import hashlib
import re

UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def decontaminate(docs, items, window=10):
    owners = {}
    for item, text in items:
        w = ALNUM.findall((text or "").encode().translate(UPPER))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            owners.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for d, text in docs:
        w = ALNUM.findall((text or "").encode().translate(UPPER))
        hit, found = [0] * len(w), set()
        for n in {len(k) for k in owners}:
            for i in range(len(w) - n + 1):
                if own := owners.get(tuple(w[i : i + n])):
                    found |= own
                    hit[i : i + n] = [1] * n
        out.append((d, len(w), sum(hit), len(found), sha(",".join(sorted(map(str, found))).encode()), any(hit)))
    return out


def repeated_bytes(docs, width=100):
    rows = sorted((d, (t or "").encode()) for d, t in docs)
    first = {}
    for d, x in rows:
        for i in range(len(x) - width + 1):
            first.setdefault(x[i : i + width], (d, i))
    out = {}
    for d, x in rows:
        gone = bytearray(len(x))
        for i in range(len(x) - width + 1):
            if first[x[i : i + width]] < (d, i):
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(x)) if gone[i] and not (i and gone[i - 1]))
        out[d] = (len(x), sum(gone), spans, sha(bytes(a for a, g in zip(x, gone) if not g)))
    return out


def repeated_lines(docs, least_lines=2, least_bytes=40):
    rows = sorted((d, (t or "").encode()) for d, t in docs)
    seen, out = set(), {}
    for d, x in rows:
        at = [(m.start(), m.end()) for m in re.finditer(rb"[^\n]+", x)]
        gone = bytearray(len(x) + 1)
        for i, (s, _) in enumerate(at):
            passages = [(s, e) for _, e in at[i + least_lines - 1 :] if e - s >= least_bytes]
            for s, e in passages:
                if x[s:e] in seen:
                    gone[s : e + (x[e : e + 1] == b"\n")] = b"\1" * (e + (x[e : e + 1] == b"\n") - s)
            seen |= {x[s:e] for s, e in passages}
        cuts = sum(1 for i in range(len(x)) if gone[i] and not (i and gone[i - 1]))
        out[d] = (len(at), cuts, sum(gone[s] for s, _ in at), bytes(a for a, g in zip(x, gone) if not g).decode())
    return out


def repeated_words(docs, width=13):
    rows = sorted((d, SPACED.findall((t or "").encode())) for d, t in docs)
    first = {}
    for d, w in rows:
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    out = {}
    for d, w in rows:
        gone = bytearray(len(w))
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = b"\1" * width
        out[d] = (len(w), sum(gone), sha(b" ".join(a for a, g in zip(w, gone) if not g)))
    return out


def near_duplicates(docs, n, percent=80):
    sets = {}
    for d, text in docs:
        w = SPACED.findall((text or "").encode().translate(UPPER))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def top_k(vectors, asked, k=5):
    import math

    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in whole if asked(i)):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def equal_texts(docs):
    """docs: (doc_id, text), in the order in which they are read; the result is in that order."""
    same = {}
    for row, (d, text) in enumerate(docs):
        same.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), d is None, d or 0, row))
    out = [None] * len(docs)
    for text, rows in same.items():
        keep = min(rows)
        for _, _, _, row in rows:
            out[row] = (docs[row][0], docs[keep[3]][0], len(rows), row == keep[3], sha(text.encode()))
    return out


def numbers(vector, scale):
    """Whole components, or None where a vector takes no part."""
    import math

    sound = vector is not None and all(x is not None and math.isfinite(x) for x in vector)
    return [math.floor(scale * x) for x in vector] if sound else None


def hard_negatives(rows, anchor, positives=5, negatives=3, low=50, high=95, scale=256):
    """rows: (vec_id, label, vector); of one id only the least (label, components) counts."""
    own = {}
    for i, label, v in rows:
        if i is not None and label is not None and (w := numbers(v, scale)) is not None:
            own[i] = min(own.get(i, (label, w)), (label, w))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in filter(anchor, own):
        scored = sorted((-dot(own[a][1], v), i) for i, (_, v) in own.items() if i != a)
        for p, i in [x for x in scored if own[x[1]][0] == own[a][0]][:positives]:
            found = [(s, j) for s, j in scored if own[j][0] != own[a][0] and low * -p <= 100 * -s <= high * -p]
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j) in enumerate(found[:negatives])]
    return sorted(out)


def clusters(rows, k=16, width=64, scale=64, rounds=3):
    """rows: (vec_id, vector)."""
    kept = [(i, w) for i, v in rows if (w := numbers(v, scale)) is not None and len(w) == width]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~", w) for i, w in kept)
    centroids = [w for _, w in first[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for n in range(rounds + 1):
        near = [min((far(w, c), j) for j, c in enumerate(centroids)) for _, w in kept]
        for j in range(len(centroids) if n < rounds else 0):
            own = [w for (_, w), (_, c) in zip(kept, near) if c == j]
            centroids[j] = [sum(x) // len(own) for x in zip(*own)] if own else centroids[j]
    sums = {j: sum(d for d, c in near if c == j) for j in range(len(centroids))}
    return [(i, c, d, sums[c], sum(sums.values()), sha(",".join(map(str, centroids[c])).encode())) for (i, _), (d, c) in zip(kept, near)]
