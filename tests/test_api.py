"""Per-business look-ups equal the all-business results filtered by id."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, biz, feedback, review
from trustlens import api
from trustlens import operators as O
from trustlens.plans.contract import rounded
from trustlens.schemas import Feedback
from trustlens.sources import load_profile


@pytest.fixture(scope="module")
def data(spark):
    return load_profile(spark, SF_SMALL, "orders")


def _same(a, b, order=None):
    """Equal rows; doubles compared at 6 decimals (sums may add in another order). With
    ``order`` the rows of ``a`` must also come in the order of that column, NULL last."""
    a, b = rounded(a), rounded(b)
    if order:
        seen = [r[order] for r in a.collect()]
        assert seen == sorted(seen, key=lambda x: (x is None, x))
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("bid", [3, 42])
def test_lookups_match_filtered_results(data, bid):
    fb, as_of = data
    assert _same(api.business_overview(fb, bid, as_of), O.business_overview(fb, as_of).filter(F.col("id") == bid))
    assert _same(api.trust_score(fb, bid, as_of), O.trust_score(fb, as_of).filter(F.col("business_id") == bid))
    assert _same(
        api.industry_benchmark(fb, bid, as_of), O.business_benchmark(fb, as_of).filter(F.col("business_id") == bid)
    )
    assert _same(
        api.sentiment_distribution(fb, bid, as_of),
        O.sentiment_distribution(fb, as_of).filter(F.col("business_id") == bid),
    )
    assert _same(
        api.performance_deltas(fb, bid, as_of), O.performance_deltas(fb, as_of).filter(F.col("business_id") == bid)
    )
    monthly = O.rating_trend_monthly(fb).filter(F.col("business_id") == bid)
    assert _same(api.rating_trend_monthly(fb, bid), monthly, "date")
    assert _same(api.business_trends(fb, bid), O.business_trends(fb).filter(F.col("business_id") == bid), "date")


def test_unknown_id(data):
    """No rows, but zeros for the sentiment mix and the changes."""
    fb, as_of = data
    assert api.business_overview(fb, 10**9, as_of).count() == 0
    assert api.rating_trend_monthly(fb, 10**9).count() == 0
    assert [tuple(r) for r in api.sentiment_distribution(fb, 10**9, as_of).collect()] == [(10**9, 0, 0, 0)]
    assert [tuple(r) for r in api.performance_deltas(fb, 10**9, as_of).collect()] == [(10**9, 0.0, 0.0, 0.0)]


def test_null_month_comes_last(spark):
    fb = feedback(spark, [biz(1)], [review(1, 1, 5, None), review(2, 1, 4, "2024-03-05 00:00:00"), review(3, 1, 2, "2024-01-05 00:00:00")])
    dates = [r["date"] for r in api.rating_trend_monthly(fb, 1).collect()]
    assert [d and d.month for d in dates] == [1, 3, None]


def test_every_series_is_in_date_order(spark, data):
    """O5 and O9, collected without adaptive execution over several partitions."""
    fb, _ = data
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    extra = feedback(spark, [], [review(-1, 7, 3, None)])
    reviews = fb.reviews.unionByName(extra.reviews)
    try:
        for op in (O.business_trends, O.rating_trend_monthly):
            series = {}
            for r in op(Feedback(fb.businesses, reviews, fb.responses)).collect():
                series.setdefault(r["business_id"], []).append(r["date"])
            assert len(series) > 100 and series[7][-1] is None
            for dates in series.values():
                assert dates == sorted(dates, key=lambda x: (x is None, x))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_one_instant_per_call(spark, data):
    from datetime import datetime, timezone

    from trustlens.functions.clock import as_of_ts, fixed_as_of

    now = fixed_as_of(spark, None)
    assert isinstance(now, str) and datetime.fromisoformat(now)
    assert fixed_as_of(spark, "2024-01-01") == "2024-01-01"
    with pytest.raises(ValueError):
        as_of_ts(datetime(2024, 1, 1, 0, 30, tzinfo=timezone.utc))
    fb, _ = data
    assert api.trust_score(fb, 3).count() == 1  # as_of=None


def test_labels(data):
    fb, _ = data
    first = O.list_businesses(fb).first()
    assert first["label"] == f"{first['name']} ({first['industry']})"
    labels = {r["month_label"] for r in O.rating_trend_monthly(fb).limit(50).collect()}
    assert all(len(x) == 6 and x[3] == " " for x in labels)


def test_lookup_with_refreshed_benchmarks(spark, data, tmp_path):
    from trustlens.plans.refresh import refresh_models

    fb, as_of = data
    models = refresh_models(fb, as_of, str(tmp_path / "models"))
    got = api.business_overview(fb, 3, as_of, benchmarks=models["industry_benchmarks"])
    assert _same(got, O.business_overview(fb, as_of).filter(F.col("id") == 3))
