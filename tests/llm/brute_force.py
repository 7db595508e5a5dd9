"""Brute-force versions that the tests compare with."""

import hashlib

import numpy as np
import xxhash


def words_of(text):
    return (text or "").encode().split()


def slow_fingerprint(text):
    w = [x.lower() for x in words_of(text)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    """fps: (id, fingerprint); the smallest id reachable over distances of four and less."""
    by = {}
    for k, f in fps:
        by.setdefault(f, []).append(k)
    x = np.array(list(by), np.uint64)
    root = np.arange(len(x))
    near = [np.flatnonzero(np.bitwise_count(x ^ f) <= 4) for f in x]
    while True:
        new = np.array([root[n].min() for n in near])
        if (new == root).all():
            break
        root = new
    name = {}
    for f, r in zip(by, root):
        name[r] = min(name.get(r, 1 << 62), min(by[f]))
    return {k: name[r] for f, r in zip(by, root) for k in by[f]}


def slow_repeats(docs):
    first = {}
    for k, t in sorted(docs):
        w = words_of(t)
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), k)
    out = {}
    for k, t in docs:
        w = words_of(t)
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < k:
                gone.update(range(i, i + 50))
        out[k] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out
