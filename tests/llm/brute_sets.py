"""Near duplicates by an exact prefix-filter join, in plain Python."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < k:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1))


def components(docs, k=3, percent=85):
    """doc_id -> (set size, least id reachable), for distinct ids."""
    sets = {i: shingles(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(a, b):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    groups = defaultdict(list)
    for i, s in sets.items():
        if s:
            groups[s].append(i)
    for g in groups.values():
        for x in g:
            union(g[0], x)
    frequency = Counter(x for s in groups for x in s)
    index = defaultdict(list)
    for s, g in groups.items():
        ordered = sorted(s, key=lambda x: (frequency[x], x))
        near = set()
        for x in ordered[: len(s) - (-(-percent * len(s) // 100)) + 1]:
            near.update(index[x])
            index[x].append(s)
        for t in near:
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                union(g[0], groups[t][0])
    return {i: (len(s), find(i)) for i, s in sets.items()}
