"""Line dedup within one word edit, in plain Python."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def dedup(docs, near_words=8):
    """doc_id -> (kept text, n_lines, n_exact, n_near), for distinct ids; every pair of lines is compared."""
    seen = []
    for i, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            w = tuple(WORD.findall(line))
            if w:
                seen.append((i, n, w))
    seen.sort(key=lambda x: x[:2])
    first, near = {}, set()
    for i, n, w in seen:
        if w not in first:
            if len(w) >= near_words and any(len(o) >= near_words and one_edit(w, o) for o in first):
                near.add(w)
            first[w] = (i, n)
    counts, gone = defaultdict(lambda: [0, 0]), defaultdict(set)
    for i, n, w in seen:
        if w in near or first[w] != (i, n):
            counts[i][1 if w in near else 0] += 1
            gone[i].add(n)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        text = t if i not in gone else "\n".join(x for n, x in enumerate(lines) if n not in gone[i])
        out[i] = (text, sum(bool(WORD.search(x)) for x in lines), *counts[i])
    return out
