from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from brute_sets import components as brute

from trustlens.llm import chosen_path
from trustlens.llm.components import components
from llm_fixtures import make_docs, shipped  # noqa: F401


def _found(docs, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in chosen_path.near_duplicates(docs, **options).collect()}


def _check(rows, found, **options):
    want = brute(rows, **options)
    assert {i: v[:2] for i, v in found.items()} == want
    assert all(v[2] == (v[1] == i) for i, v in found.items())


def _edited(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    """Originals with copies that lose up to a third of their shingles, a shared line, exact copies."""
    rng = random.Random(5)
    rows, line = [], " ".join(f"common{i}" for i in range(9))
    for base in range(40):
        words = [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(20, 160))]
        for copy in range(rng.choice([1, 1, 2, 5])):
            text = " ".join(_edited(rng, words, rng.randrange(0, 4)))
            rows.append((len(rows) * 3 + 1, (line + "\n" + text) if base % 3 else text.upper()))
    rows += [(10_000 + i, rows[0][1]) for i in range(30)]
    return rows


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_equals_brute_force(make_docs, corpus, k, percent):
    _check(corpus, _found(make_docs(corpus), k=k, percent=percent), k=k, percent=percent)


def test_large_groups_branch_and_use_pivots(make_docs, corpus, monkeypatch):
    """With tiny leaves every group passes the recursion and the pivots; results stay exact."""
    rng = random.Random(8)
    words = [f"z{i}" for i in range(120)]
    rows = corpus + [(20_000 + i, " ".join(_edited(rng, words, i % 6))) for i in range(60)]
    monkeypatch.setattr(chosen_path, "LEAF", 6)
    _check(rows, _found(make_docs(rows), k=3, percent=85), k=3, percent=85)


def test_sets_go_to_small_nodes_in_parts_and_are_not_stored(make_docs, corpus, monkeypatch):
    """No part receives the sets of all small nodes, and no copy of the sets lies in the checkpoint folder beside their shuffle."""
    given, kept = [], []
    sets, store = chosen_path.shingle_sets, chosen_path.materialize
    monkeypatch.setattr(chosen_path, "shingle_sets", lambda docs, ids, *a: given.append(ids.count()) or sets(docs, ids, *a))
    monkeypatch.setattr(chosen_path, "materialize", lambda df: kept.append(df.columns) or store(df))
    _check(corpus, _found(make_docs(corpus), k=3, percent=85), k=3, percent=85)
    assert len(given) == chosen_path.PARTS and all(0 < n < sum(given) for n in given)
    assert not any("items" in columns for columns in kept)


def test_cases(make_docs):
    rows = [(5, None), (4, ""), (3, " \n "), (9, "two words"), (8, "TWO  words"), (7, "a b c"), (7, "a b c"), (6, "x y z"), (None, "a b c"), (None, None)]
    got = chosen_path.near_duplicates(make_docs(rows, extra=["id", "sketch", "component_id"]), k=3, percent=85).collect()
    seen = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in got)
    assert seen == sorted(
        [(5, 0, 5, True), (4, 0, 4, True), (3, 0, 3, True), (9, 1, 8, False), (8, 1, 8, True), (7, 1, 7, True),
         (7, 1, 7, True), (6, 1, 6, True), (0, 1, 0, True), (0, 0, 0, True)]
    )


def test_an_id_with_two_texts_joins_their_groups(make_docs):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "p q r s t"), (3, "p q r s t")]
    got = chosen_path.near_duplicates(make_docs(rows), k=3, percent=85).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1)}


def test_empty_table_and_long_text(make_docs):
    assert chosen_path.near_duplicates(make_docs([])).count() == 0
    text = " ".join(f"w{i % 70_001}" for i in range(300_000))
    rows = [(1, text), (2, text + " end"), (3, "other words entirely here now")]
    _check(rows, _found(make_docs(rows)), k=5, percent=80)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(300, 500)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(chain + star, "u long, v long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 5 for i in [5, *range(300, 500)])
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_trees_follow_the_recall():
    assert chosen_path.trees_for(0.8) > chosen_path.trees_for(0.95) >= 1
    assert chosen_path.trees_for(0.85, 0.999999) > chosen_path.trees_for(0.85, 0.9)


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_at_the_threshold_meet_in_deep_trees(spark, percent):
    """Follows the nodes that the two sets of a pair share down to level 24."""
    rng, depth, pairs, similar = random.Random(3), 24, 150, percent / 100
    rows = []
    for pair in range(pairs):
        a = [rng.randrange(2**31) for _ in range(chosen_path.COORDINATES)]
        same = set(rng.sample(range(len(a)), math.ceil(similar * len(a))))
        b = [x if i in same else rng.randrange(2**31) for i, x in enumerate(a)]
        rows += [(pair, 0, 0, a), (pair, 1, 0, b)]
    sets = spark.createDataFrame(rows, "id long, sid long, c long, sketch array<int>").cache()
    trees = chosen_path.trees_for(similar, depth=depth)
    nodes = chosen_path._roots(sets, range(trees * chosen_path.BRANCHES[0]))
    for level in range(1, depth + 1):
        both = nodes.groupBy("id", "node").agg(F.countDistinct("sid").alias("n")).where("n = 2").select("id", "node")
        met = both.checkpoint()
        if level < depth:
            nodes = chosen_path._children(met.join(sets, "id"), level, similar)
    assert met.select("id").distinct().count() >= pairs - 3


def test_deep_trees_are_added(make_docs, monkeypatch):
    """Leaves of two sets and alike sets without links: the trees go deeper than BRANCHES."""
    rng, ranges, roots = random.Random(9), [], chosen_path._roots
    words = [f"z{i}" for i in range(150)]
    rows = [(i, " ".join(_edited(rng, words, 5))) for i in range(60)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(0, 60, 3)]
    monkeypatch.setattr(chosen_path, "LEAF", 2)
    monkeypatch.setattr(chosen_path, "BRANCHES", (2, 2))
    monkeypatch.setattr(chosen_path, "_roots", lambda sets, slots: ranges.append(slots) or roots(sets, slots))
    _check(rows, _found(make_docs(rows), k=3, percent=85), k=3, percent=85)
    assert len(ranges) > 1 and all(a.stop == b.start for a, b in zip(ranges, ranges[1:]))


def test_likeness_bounds_the_similarity(spark):
    """Pairs of all sizes, across levels and around the threshold: the true similarity lies within the bounds."""
    rng, rows, true = np.random.default_rng(4), [], []
    for i in range(400):
        size = int(rng.choice([3, 30, 300, 1000, 1023, 1024, 1500, 2047, 2048, 5000, 40_000]))
        gone = int(size * rng.choice([0, 0.02, 0.08, 0.1, 0.2, 0.6]))
        more = int(size * rng.choice([0, 0.05, 0.15, 1.5, 5]))
        pool = rng.integers(0, 1 << 63, size + more, dtype=np.uint64)
        a, b = np.unique(pool[:size]), np.unique(pool[gone:])
        true.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        rows.append((i, len(a), len(b), chosen_path.odd_sketches(a).tolist(), chosen_path.odd_sketches(b).tolist()))
    table = spark.createDataFrame(rows, "i int, n long, m long, x array<long>, y array<long>")
    low, high = chosen_path.likeness("x", "y", "n", "m")
    got = table.select("i", low.alias("low"), high.alias("high")).collect()
    assert all(r["low"] <= true[r["i"]] + 1e-9 and r["high"] >= true[r["i"]] - 1e-9 for r in got)
    # and they are tight near the threshold
    wide = [r["high"] - r["low"] for r in got if 0.8 <= true[r["i"]] < 1]
    assert len(wide) > 40 and max(wide) < 0.35 and sorted(wide)[len(wide) // 2] < 0.16


def test_sets_above_the_whole_size_are_confirmed_by_a_join(make_docs, corpus, monkeypatch):
    """Pairs of large sets, and of a large and a small one, take the join; all others their node."""
    calls, plain = [], chosen_path.confirm
    monkeypatch.setattr(chosen_path, "WHOLE", 80)
    monkeypatch.setattr(chosen_path, "confirm", lambda *args: calls.append(1) or plain(*args))
    _check(corpus, _found(make_docs(corpus), k=3, percent=85), k=3, percent=85)
    assert calls


@pytest.mark.parametrize("whole", [0, 2048])
def test_group_around_the_threshold(make_docs, monkeypatch, whole):
    """Hundreds of copies whose similarities scatter around the threshold: many refused pairs lie beside the links."""
    rng = random.Random(12)
    words = [f"q{i}" for i in range(70)]
    rows = [(i, " ".join(_edited(rng, words, i % 5))) for i in range(200)]
    monkeypatch.setattr(chosen_path, "WHOLE", whole)
    _check(rows, _found(make_docs(rows), k=3, percent=85), k=3, percent=85)


def _table(rows):
    """The rows (node, id, c, items) as a comparison receives them."""
    rows = sorted(rows, key=lambda r: r[0])
    sets = [np.unique(r[3]) for r in rows]
    return pa.table({
        "node": [r[0] for r in rows], "id": [r[1] for r in rows], "c": [r[2] for r in rows], "slot": [-1] * len(rows),
        "seen": [0] * len(rows), "size": [len(x) for x in sets], "sketch": [[0, 0]] * len(rows),
        "odd": [chosen_path.odd_sketches(x).tolist() for x in sets],
        "items": pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
    })


def test_links_of_a_node_are_no_more_than_its_sets():
    """A group of copies gives a forest of true links; the same components as all pairs; known components are left alone."""
    rng, rows = np.random.default_rng(6), []
    base = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    for i in range(120):
        items = base.copy()
        items[rng.choice(100, rng.integers(0, 14), replace=False)] = rng.integers(0, 1 << 63, 1, dtype=np.uint64)[0] + i
        rows.append((i % 3, i, 1000 if i < 6 else i, items))
    table = _table(rows)
    nodes = chosen_path._Nodes(table, 0.85, 2)
    found = list(chosen_path._linked(nodes, table.column("items").combine_chunks(), 85))
    parts = {i: i for i in range(120)}

    def root(x):
        while parts[x] != x:
            x = parts[x]
        return x

    sets = {i: set(items.tolist()) for _, i, _, items in rows}
    true = {(a, b) for a in sets for b in sets if a < b and a % 3 == b % 3 and len(sets[a] & sets[b]) * 100 >= 85 * len(sets[a] | sets[b])}
    for a, b, _, linked in found:
        assert linked and (a, b) in true and root(a) != root(b) and not (a < 6 and b < 6)
        parts[root(a)] = root(b)
    for a, b in true:
        known = {root(x) for x in range(6)}
        assert root(a) == root(b) or (root(a) in known and root(b) in known)
    marked = {int(i) for i in nodes.ids[chosen_path._marked(nodes)]}
    assert marked >= {x for a, b in true if not (a < 6 and b < 6) for x in (a, b)}
