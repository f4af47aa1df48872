"""Slow, obvious versions of the corpus operators, on lists of plain rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n = len(words)
    measures = (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return (*measures, n < 50 or 100 * len(covered) > 50 * n)


def exact(rows):
    """(doc_id, text) -> sorted (doc_id, keep_id, size, kept, sha256)."""
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in rows]
    groups = defaultdict(list)
    for d, t in norm:
        groups[t].append(d)
    out, seen = [], set()
    for d, t in sorted(norm, key=lambda x: (x[0] is None, x[0] or 0)):
        known = [x for x in groups[t] if x is not None]
        out.append((d, min(known, default=None), len(groups[t]), t not in seen, hashlib.sha256(t.encode()).hexdigest()))
        seen.add(t)
    return sorted(out, key=repr)


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, prints, distance=4):
    """(doc_id, fingerprint) rows by comparing everything -> {doc_id: smallest reachable id}."""
    values = sorted(set(prints))
    first = {v: min(d for d, p in zip(rows, prints) if p == v) for v in values}
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    array = np.array(values, dtype=np.uint64)
    for i, v in enumerate(values):
        for j in np.nonzero(np.bitwise_count(array ^ array[i]) <= distance)[0]:
            a, b = root(v), root(values[j])
            if a != b:
                parent[max(a, b, key=first.get)] = min(a, b, key=first.get)
    least = defaultdict(lambda: 1 << 62)
    for v in values:
        least[root(v)] = min(least[root(v)], first[v])
    return {d: least[root(p)] for d, p in zip(rows, prints)}


def targets(sizes):
    """[(source, words)] -> {source: target}, by resharing until nothing is above its ceiling."""
    names = sorted((s for s, _ in sizes), key=lambda s: (s is None, s or ""))
    size, weight = dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, list(names), 1.5 * sum(size.values())
    while free:
        each = left / sum(weight[s] for s in free)
        above = [s for s in free if weight[s] * each >= 2 * size[s]]
        if not above:
            return target | {s: weight[s] * each for s in free}
        for s in above:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.remove(s)
    return target


def highest_quotients(votes, seats):
    """[votes] -> seats each, one seat at a time; ties to the first."""
    won = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def pieces(ids, limit=1024):
    """Ids of one document (with its end) -> (piece, start, length, crc)."""
    if len(ids) <= limit:
        cuts = [0, len(ids)]
    else:
        cuts = [0, *range(len(ids) % limit or limit, len(ids) + 1, limit)]
    return [
        (i, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
    ]


def without_near_copies(rows):
    """Sorted ids that stay, of (doc_id, text) with distinct ids: Jaccard 0.8 on five-word shingles, all pairs."""
    rows = sorted(rows)
    sets, root = [], list(range(len(rows)))
    for _, text in rows:
        words = [w.lower() for w in WORD.findall(text or "")]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return [d for i, (d, _) in enumerate(rows) if root[i] == i]
