"""Invariants over the driver tables (both fixture profiles)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from trustlens import operators as O
from trustlens.schemas import Feedback
from trustlens.sources import load_profile


@pytest.fixture(scope="module", params=["orders", "events"])
def profile(spark, request):
    return load_profile(spark, SF_SMALL, request.param)


def test_trust_ranges(profile):
    fb, as_of = profile
    t = O.trust_score(fb, as_of)
    bad = t.filter(
        (F.col("trust_score").isNotNull() & ~F.col("trust_score").between(0, 100))
        | ~F.col("response_rate").between(0.0, 1.0)
        | (F.col("weighted_rating").isNotNull() & ~F.col("weighted_rating").between(1.0, 5.0))
    )
    assert bad.count() == 0


def test_last_cumulative_equals_total(profile):
    fb, _ = profile
    last = O.daily_stats(fb).groupBy("business_id").agg(F.max("cumulative_reviews").alias("c"))
    total = fb.reviews.groupBy("business_id").agg(F.count(F.lit(1)).alias("c"))
    assert last.exceptAll(total).count() == 0 and total.exceptAll(last).count() == 0


def test_sentiment_counts_sum_to_window_rows(profile):
    fb, as_of = profile
    s = O.sentiment_distribution(fb, as_of).agg(F.sum(F.col("Positive") + F.col("Neutral") + F.col("Negative")))
    known = fb.businesses.select("id")
    window = fb.reviews.filter(F.col("created_at") >= F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 60 DAYS"))
    in_window = window.join(known, window["business_id"] == known["id"], "left_semi").count()
    assert s.first()[0] == in_window


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_results_independent_of_partitioning(spark, profile, parts):
    fb, as_of = profile
    base = O.business_overview(fb, as_of)
    split = Feedback(fb.businesses.repartition(parts), fb.reviews.repartition(parts), fb.responses.repartition(parts))
    again = O.business_overview(split, as_of)
    assert base.exceptAll(again).count() == 0 and again.exceptAll(base).count() == 0


def test_results_independent_of_session_time_zone(spark, profile):
    from trustlens.plans.contract import rounded

    fb, as_of = profile
    ops = [
        lambda: O.performance_deltas(fb, as_of),
        lambda: O.sentiment_distribution(fb, as_of),
        lambda: O.rating_trend_monthly(fb),
        lambda: O.daily_stats(fb),
    ]
    before = [rounded(op()).collect() for op in ops]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        after = [rounded(op()).collect() for op in ops]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    for b, a in zip(before, after):
        assert sorted(map(tuple, b), key=repr) == sorted(map(tuple, a), key=repr)


def test_score_against_fractional_weights(spark):
    """O2 weighs a day by the integer 730 - age. Against the fraction 1 - age / 730.0 (evaluated by
    DuckDB, in its order of addition) only the last bit of a sum differs, so a rating moves by 0.01 and a
    score by 1 at most, and only where it lies on a rounding edge."""
    import duckdb

    from conftest import SF_MID
    from trustlens.plans import contract
    from trustlens.sources.fixtures import PROFILES

    fb, as_of = contract.load_profile(spark, SF_MID, "orders")
    con = duckdb.connect()
    for t in ("customer", "nation", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_MID}/{t}.parquet')")
    sql = contract.oracle_sql()["trust_score"]
    whole = f"GREATEST(0, 730 - DATE_DIFF('day', CAST(created_at AS DATE), DATE '{PROFILES['orders'].as_of[:10]}'))"
    part = whole.replace("GREATEST(0, 730 - ", "GREATEST(CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) - ").replace("'))", "') / CAST(730 AS DOUBLE))")
    assert whole in sql
    want = {r[0]: (r[1], r[2]) for r in con.execute(f"SELECT business_id, weighted_rating, trust_score FROM ({sql.replace(whole, part)})").fetchall()}
    got = {r["business_id"]: (r["weighted_rating"], r["trust_score"]) for r in contract.rounded(O.trust_score(fb, as_of)).collect()}
    assert set(got) == set(want) and len(got) > 900
    differing = 0
    for i, (rating, score) in got.items():
        assert (rating is None) == (want[i][0] is None) and (score is None) == (want[i][1] is None)
        if rating is not None:
            assert abs(rating - want[i][0]) <= 0.01 + 1e-9 and abs(score - want[i][1]) <= 1
            differing += (rating, score) != want[i]
    assert differing <= 0.005 * len(got)
