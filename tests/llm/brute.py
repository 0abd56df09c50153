"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

WORDS = ["".join(random.Random(k).choices("aeioulnrst", k=3 + k % 6)) + str(k % 7) * (k % 11 == 0) for k in range(3000)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near_duplicates(rows):
    """{doc_id: (set size, component)} of (doc_id, text) rows with distinct ids."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                shared[j] += 1
            holders[x].append(i)
        for j, c in shared.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeated_words(rows, run=50):
    """{doc_id: covered word positions}: words of windows that occur earlier (not overlapping, within a document)."""
    first, out = {}, {}
    for i, text in sorted(rows):
        w = (text or "").split()
        gone = set()
        for k in range(len(w) - run + 1):
            key = tuple(w[k : k + run])
            if key not in first:
                first[key] = (i, k)
            elif first[key][0] != i or k - first[key][1] >= run:
                gone.update(range(k, k + run))
        out[i] = gone
    return out


def cosine_links(vectors, limit=0.9):
    """{id: (links, component)} of (id, vector or None) rows."""
    good = {i: np.array(v, dtype=float) for i, v in vectors if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    parent = {i: i for i, _ in vectors}
    links = dict.fromkeys(parent, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(good)
    for p, i in enumerate(ids):
        for j in ids[p + 1 :]:
            a, b = good[i], good[j]
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= limit:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in parent}
