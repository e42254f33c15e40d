from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from trustlens.llm import pareto_mix
from llm_fixtures import make_docs, shipped  # noqa: F401


def _targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Source targets by repeated sharing, in plain Python."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def _mixed(docs, **options):
    return docs.sparkSession.createDataFrame(pareto_mix.mix(docs, **options).collect(), pareto_mix.mix(docs, **options).schema)


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, rng.randrange(10_000)]) for s in ["a", "B", "é", "zz", "", "\U0001f600", "￿", None][: 3 + seed]}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_docs long")
    got = {r["source"]: r["target"] for r in pareto_mix.targets(df).collect()}
    assert got == pytest.approx(_targets(sizes))


def test_taken_words_reach_the_targets(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    rows = pareto_mix.mix(docs).collect()
    taken, target, largest = {}, {}, {}
    for r in rows:
        assert 0 <= r["copies"] <= 2 and (r["copies"] == 0 or r["size"] > 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    for s, t in target.items():
        assert abs(taken[s] - t) < 0.02 * t + 30
    again = pareto_mix.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_certain_copies_and_inclusion_by_odds(make_docs):
    """One source holds little (taken twice whole); over seeds, shorter texts of the other are
    drawn more often, near the odds' ratio, and no document more than once above its whole copies."""
    rows = [(i, "w " * (10 if i % 2 else 90), "en", "big") for i in range(60)] + [(100 + i, "v " * 5, "en", "a") for i in range(4)]
    docs = make_docs(rows)
    drawn = {10: 0, 90: 0}
    for seed in range(12):
        got = pareto_mix.mix(docs, weights=(1, 1), share=0.5, seed=f"s{seed}").collect()
        for r in got:
            if r["source"] == "a":
                assert r["copies"] == 2
            else:
                drawn[r["size"]] += r["copies"]
    assert drawn[10] > 1.1 * drawn[90] > 0


def test_hot_buckets_equal_one_sorted_list(make_docs, monkeypatch):
    """Few buckets or many: the same documents."""
    rng = random.Random(7)
    docs = make_docs([(i, "w " * rng.randrange(0, 40), "en", rng.choice(["a", "b", None])) for i in range(400)])
    want = sorted(map(repr, pareto_mix.mix(docs).collect()))
    for buckets in (1, 3, 64):
        monkeypatch.setattr(pareto_mix, "BUCKETS", buckets)
        assert sorted(map(repr, pareto_mix.mix(docs).collect())) == want


def test_cases(make_docs):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " ", "en", None), (None, "x y", "en", "a"), (4, "x y z", "en", "b"),
            (4, "x y z", "en", "b"), (5, "k", None, None)]
    docs = make_docs(rows, extra=["size", "u", "odds", "bucket", "copies", "target"])
    got = pareto_mix.mix(docs).collect()
    assert len(got) == len(rows) and all(r["copies"] == 0 for r in got if r["size"] == 0)
    assert len({r["copies"] for r in got if r["doc_id"] == 4}) == 1
    mixed = pareto_mix.apply_mix(docs)
    assert mixed.columns == docs.columns
    copies = sum(r["copies"] for r in got)
    assert mixed.count() == copies and mixed.where(F.col("text").isNull()).count() == 0
    assert pareto_mix.mix(make_docs([])).count() == 0
    nothing = pareto_mix.mix(make_docs([(1, "", "en", "a"), (2, None, "en", "b")])).collect()
    assert [(r["target"], r["copies"]) for r in nothing] == [(0.0, 0)] * 2


def _shares(sizes, rest):
    """Inclusion probabilities min(1, c / sqrt(size)) with expected words ``rest``, by bisection on c."""
    low, high = 0.0, max(sizes) ** 0.5
    for _ in range(200):
        c = (low + high) / 2
        if sum(min(n, c * n**0.5) for n in sizes) < rest:
            low = c
        else:
            high = c
    return [min(1.0, low / n**0.5) for n in sizes]


@pytest.mark.parametrize("share", [0.3, 0.8, 0.97])
def test_inclusion_probabilities_sum_to_the_rest(make_docs, share):
    rng = random.Random(11)
    sizes = [rng.choice([1, 4, 9, 50, rng.randrange(1, 3000)]) for _ in range(200)]
    docs = make_docs([(i, "w " * n, "en", "a") for i, n in enumerate(sizes)] + [(900, "", "en", "a")])
    got = {r["doc_id"]: r["share"] for r in pareto_mix.mix(docs, weights=(1,), share=share).collect()}
    assert got.pop(900) is None
    want = _shares(sizes, share * sum(sizes))
    assert [got[i] for i in range(200)] == pytest.approx(want, rel=0.002)
    assert sum(got[i] * n for i, n in enumerate(sizes)) == pytest.approx(share * sum(sizes))


def test_frequencies_follow_the_inclusion_probabilities(make_docs):
    """Over seeds, documents of each size are drawn about as often as their probability says."""
    sizes = [10] * 60 + [40] * 60 + [160] * 60
    docs = make_docs([(i, "w " * n, "en", "a") for i, n in enumerate(sizes)])
    docs = docs.sparkSession.createDataFrame(docs.collect(), docs.schema).cache()
    seeds, drawn, share = 10, {}, {}
    for seed in range(seeds):
        for r in pareto_mix.mix(docs, weights=(1,), share=0.4, seed=f"f{seed}").collect():
            drawn[r["size"]] = drawn.get(r["size"], 0) + r["copies"]
            share[r["size"]] = r["share"]
    for size, p in share.items():
        n = 60 * seeds
        assert abs(drawn[size] / n - p) < 4 * (p * (1 - p) / n) ** 0.5 + 0.01
