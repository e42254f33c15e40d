"""rank_splits against a brute-force sort on adversarial shapes."""

from __future__ import annotations

import random

import pytest

from trustlens.operators.ranking import key_bits, rank_splits, ranking_keys


def brute(rows, r):
    ordered = sorted(rows, key=lambda x: (-x[0], x[1], (x[2] is None, x[2] or 0.0)))
    head, tail = ordered[:r], ordered[r:]

    def tot(part):
        vals = [x[2] for x in part if x[2] is not None]
        return len(part), sum(vals), len(vals)

    return tot(head), tot(tail)


def run(spark, rows, cuts):
    df = spark.createDataFrame(rows, "o bigint, id bigint, v double")
    keyed = ranking_keys(df, "o", "id", "v").checkpoint(eager=True)
    lo, hi = keyed.selectExpr("min(u)", "max(u)").first()
    out = {r["cut"]: r.asDict() for r in rank_splits(keyed, cuts, lo, hi).collect()}
    return out


CASES = {
    # a third of all rows share one order value (the hot group holds the cut)
    "hot_group": lambda rnd: [(7 if i % 3 == 0 else rnd.randint(1, 50), i, rnd.choice([0.5, -0.25, 0.125])) for i in range(300)],
    "negative_ids": lambda rnd: [(rnd.randint(1, 5), rnd.randint(-10**6, 10**6) * 7 + i, 0.5 * (i % 4)) for i in range(200)],
    "wide_ids": lambda rnd: [(rnd.randint(1, 3), rnd.getrandbits(63) - (1 << 62) + i, 1.0) for i in range(150)],
    # ids above 2**16 sharing high bits: two passes below a non-zero common prefix
    "mid_ids": lambda rnd: [(rnd.randint(1, 3), 70000 + rnd.randint(0, 10**6) * 3 + i, 0.5) for i in range(150)],
    "negative_mid_ids": lambda rnd: [(1, -(2**20) - 70000 * i, 0.25 * (i % 3)) for i in range(60)],
    "null_values": lambda rnd: [(rnd.randint(1, 4), i, None if i % 5 == 0 else 0.25) for i in range(120)],
    "duplicate_ids": lambda rnd: [(2, i // 3, float(i % 3)) for i in range(90)],
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_rank_splits_match_sort(spark, case):
    rnd = random.Random(case)
    rows = CASES[case](rnd)
    n = len(rows)
    cuts = {"a": 1, "b": n // 5, "c": n // 2 + 1, "d": n}
    got = run(spark, rows, cuts)
    assert set(got) == set(cuts)
    for name, r in cuts.items():
        head, tail = brute(rows, r)
        g = got[name]
        assert (g["head_n"], g["head_c"], g["tail_n"], g["tail_c"]) == (head[0], head[2], tail[0], tail[2])
        assert g["head_s"] == pytest.approx(head[1]) and g["tail_s"] == pytest.approx(tail[1])


def test_cut_outside_range_gives_no_row(spark):
    got = run(spark, [(1, 1, 1.0), (2, 2, 2.0)], {"zero": 0, "over": 3, "ok": 2})
    assert set(got) == {"ok"}


def test_key_bits():
    assert key_bits(-(1 << 63), -(1 << 63) + 65535) == 16
    assert key_bits(-(1 << 63) + 5, -(1 << 63) + 5) == 0
    assert key_bits(-1, 0) == 64


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(
        st.tuples(
            st.integers(0, 4),
            st.integers(-(2**40), 2**40),
            st.one_of(st.none(), st.sampled_from([-0.5, 0.25, 0.75])),
        ),
        min_size=1,
        max_size=40,
        unique_by=lambda t: t[1],
    ),
    frac=st.floats(0.0, 1.0),
)
def test_rank_splits_property(spark, rows, frac):
    r = max(1, min(len(rows), int(len(rows) * frac) or 1))
    got = run(spark, rows, {"x": r})["x"]
    head, tail = brute(rows, r)
    assert (got["head_n"], got["head_c"], got["tail_n"], got["tail_c"]) == (head[0], head[2], tail[0], tail[2])
    assert got["head_s"] == pytest.approx(head[1]) and got["tail_s"] == pytest.approx(tail[1])
