"""Plain single-machine versions of the operators' contracts, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def shingles(text, n=4):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(docs, n=4):
    """doc_id -> (set size, component) of (doc_id, text) rows with distinct ids."""
    sets = {d: shingles(t, n) for d, t in docs}
    parent = {d: d for d in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def without_repeats(docs, n=13):
    """doc_id -> (n_words, n_removed, sha256)."""
    split = {d: words(t) for d, t in docs}
    first = {}
    for d, w in split.items():
        for i in range(len(w) - n + 1):
            key = tuple(w[i:i + n])
            first[key] = min(d, first.get(key, d))
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i:i + n])] < d:
                gone[i:i + n] = [True] * n
        kept = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def base_scores(docs):
    """doc_id -> (n_tokens, n_known, N, base_score)."""
    def tokens(t):
        return [w.lower() for w in words(t)] + [None]

    counts = collections.Counter(x for d, t in docs if remainder(d, 5) != 1 for x in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    out = {}
    for d, t in docs:
        mine = tokens(t)
        out[d] = (len(mine), sum(counts[x] > 0 for x in mine), total,
                  sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in mine))
    return out


def secret_bases(text):
    """(kind, start, end) in listed order."""
    text = text or ""
    found = []
    for rank, (kind, pattern, fits) in enumerate((
            ("assign", r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8),
            ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32))):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if fits(m)]
    return [(k, a, b) for a, _, k, b in sorted(found)]
