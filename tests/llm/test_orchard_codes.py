from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from conftest import SF_MID
from trustlens.llm import orchard_codes as oc
from trustlens.llm import queries
from llm_fixtures import shipped  # noqa: F401

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error, sha) rows by plain exhaustive search in Python integers."""
    kept = []
    for vec_id, vector, label in rows:
        if vector is None or any(x is None or not math.isfinite(x) for x in vector) or not vector or len(vector) % parts:
            continue
        kept.append((vec_id, [math.floor(1024 * float(x)) for x in vector], label, vector))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    if not kept:
        return []
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    width = dim // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[1], p) for r in kept[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = {}
            for r in kept:
                groups.setdefault(nearest(r[1], p)[1], []).append(cut(r[1], p))
            new.append([
                [sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])
            ])
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for vec_id, v, label, _ in kept:
        found = [nearest(v, p) for p in range(parts)]
        error = sum(d for d, _ in found)
        sums[label] = sums.get(label, 0) + error
        out.append((vec_id, "".join(f"{i:02x}" for _, i in found), error, label))
    return [(i, c, e, sums[label], sha) for i, c, e, label in out]


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def vectors(n, dim, seed, groups=5):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    out = []
    for i in range(n):
        c = rng.choice(centres)
        v = np.float32([x + rng.gauss(0, 0.3) for x in c]).tolist()
        out.append((i * 3 - 5, v, rng.choice([None, 1, 2])))
    return out


@pytest.mark.parametrize("block", [1, 3, 32])
def test_search_equals_exhaustive_search(block):
    rng = np.random.default_rng(block)
    for spread, n in ((3, 200), (40, 7), (900, 256), (1 << 25, 60)):
        entries = rng.integers(-spread, spread, (n, 4))
        entries[n // 2 :: 5] = entries[0]  # equal entries: the lowest index wins
        x = np.concatenate([rng.integers(-spread, spread, (300, 4)), entries])
        far = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        index, distance = oc.Orchard(entries, block).nearest(x)
        assert (index == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()


def test_search_prunes():
    """On well separated entries most list entries lie beyond the bound and are never compared."""
    rng = np.random.default_rng(3)
    entries = rng.integers(-100_000, 100_000, (256, 4))
    search = oc.Orchard(entries, 1)
    x = entries[rng.integers(0, 256, 500)] + rng.integers(-50, 50, (500, 4))
    index, _ = search.nearest(x)
    assert search.compared < 0.4 * 500 * 256
    assert (index == ((x[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.schema(SCHEMA).parquet(f"{SF_MID}/embeddings.parquet").collect()]
    assert order(queries.queries()["op11_orchard_codes"](spark, SF_MID).collect()) == order(brute(rows))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(330, 8, 4)
    rows += [(7000, None, 1), (7001, [], 1), (7002, [1.0] * 7 + [nan], 1), (7003, [1.0] * 7 + [None], 2), (7004, [-inf] + [0.0] * 7, 1)]
    rows += [(-100, [nan] * 8, 1), (7005, [0.5] * 4, 1), (7006, [1.0] * 7, 1)]
    rows += [(None, [0.25] * 8, 3), (None, [-0.25] * 8, None)] + [rows[5]] * 40 + [rows[6]]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS code", "1 AS error", "2 AS salt", "3 AS whole")
    want = order(brute(rows))
    assert order(oc.compress(df).collect()) == want and len(want) == 330 + 2 + 41
    assert order(oc.compress(df.repartition(7)).collect()) == want


def test_many_labels_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(oc, "MAX_BROADCAST_ROWS", 2)
    rows = vectors(300, 4, 5)
    assert order(oc.compress(spark.createDataFrame(rows, SCHEMA)).collect()) == order(brute(rows))


def test_few_rows_and_none(spark):
    rows = vectors(3, 4, 6)
    assert order(oc.compress(spark.createDataFrame(rows, SCHEMA)).collect()) == order(brute(rows))
    none = oc.compress(spark.createDataFrame([(1, None, 1)], SCHEMA))
    assert none.collect() == [] and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert oc.compress(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_large_components_are_held(spark):
    rows = [(1, [1e30, -1e30, 3.0, 4.0], 1), (2, [0.0, 0.0, 0.0, 0.0], 1)]
    got = oc.compress(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["code"], r["error"]) for r in sorted(got)] == [("00000000", 0), ("01010101", 0)]


def test_decode_is_near():
    books = np.arange(2 * 3 * 2).reshape(2, 3, 2) * oc.SCALE
    assert oc.decode(["0002", "0100"], books).tolist() == [[0, 1, 10, 11], [2, 3, 6, 7]]
