"""Hand-written edge cases of the metric definitions (as_of = 2024-06-30 12:00:00)."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from conftest import biz, feedback, reply, review, rows_by, ts
from trustlens import operators as O
from trustlens.functions import half_even_int, round2

AS_OF = "2024-06-30 12:00:00"


def test_numeric_helpers(spark):
    vals = spark.createDataFrame([(2.5,), (3.5,), (2.51,), (1.005,), (0.285,), (-2.5,)], "x double")
    got = [(r[0], r[1]) for r in vals.select(half_even_int(F.col("x")), round2(F.col("x"))).collect()]
    assert got == [(2, 2.5), (4, 3.5), (3, 2.51), (1, 1.0), (0, 0.28), (-2, -2.5)]


@pytest.fixture(scope="module")
def shop(spark):
    """Business 1: replies 0/1/3; 2: no reviews; 3: only old reviews; 4: future + today;
    5: NULL rating; 6: NULL sentiment / NULL date / sentiment edges; 7: period edges."""
    businesses = [biz(i) for i in range(1, 8)]
    reviews = [
        review(10, 1, 5, "2024-06-20 10:00:00", 0.5),
        review(11, 1, 4, "2024-06-21 10:00:00", -0.5),
        review(12, 1, 3, "2024-06-22 10:00:00", 0.0),
        review(30, 3, 4, "2022-06-30 00:00:00"),  # 731 days before the as-of day
        review(31, 3, 2, "2021-01-01 00:00:00"),
        review(40, 4, 5, "2024-07-01 09:00:00"),  # after as_of: weight 731
        review(41, 4, 1, "2024-06-30 08:00:00"),  # weight 730
        review(50, 5, 4, "2024-06-29 23:59:00"),  # late evening the day before: days_ago 1
        review(51, 5, None, "2024-06-29 08:00:00"),
        review(60, 6, 3, "2024-06-25 10:00:00", None),
        review(61, 6, 3, None, -0.9),
        review(62, 6, 3, "2024-06-25 11:00:00", 0.2),
        review(63, 6, 3, "2024-06-25 12:00:00", -0.2),
        review(70, 7, 5, "2024-05-31 00:00:00", -0.5),  # current period starts here
        review(71, 7, 1, "2024-05-30 23:59:59", -0.5),  # previous
        review(72, 7, 2, "2024-05-01 00:00:00", 0.5),  # previous starts here
        review(73, 7, 4, "2024-04-30 23:59:59", 0.5),  # outside both periods
        review(74, 7, 3, "2024-05-01 12:00:00", 0.5),  # inside the 60 x 24 h window
        review(75, 7, 3, "2024-05-01 11:59:59", 0.5),  # outside it
    ]
    responses = [reply(100, 11), reply(101, 12), reply(102, 12), reply(103, 12)]
    return feedback(spark, businesses, reviews, responses)


def test_trust_score_edges(shop):
    t = rows_by(O.trust_score(shop, AS_OF), "business_id")
    assert 2 not in t  # no reviews: absent
    assert t[1]["response_rate"] == 0.8  # (0 + 1 + 3) / (1 + 1 + 3)
    assert t[3]["weighted_rating"] is None and t[3]["trust_score"] is None and t[3]["total_reviews"] == 2
    assert t[4]["weighted_rating"] == round((5 * 731 + 1 * 730) / 1461, 2)
    assert t[5]["weighted_rating"] == 2.0  # NULL rating stays in the denominator
    # score from unrounded inputs: rating 2.0 -> 20, rate 0 -> 0, volume log10(3)*50*0.2
    assert t[5]["trust_score"] == round(2.0 / 5 * 100 * 0.5 + min(math.log10(3) * 50, 100) * 0.2)


def test_volume_saturates(spark):
    businesses = [biz(1), biz(2), biz(3)]
    reviews, rid = [], 0
    for b, n in ((1, 98), (2, 99), (3, 100)):
        for _ in range(n):
            rid += 1
            reviews.append(review(rid, b, 5, "2024-06-30 00:00:00"))
    t = rows_by(O.trust_score(feedback(spark, businesses, reviews), AS_OF), "business_id")
    # rating part 50, replies 0, volume part 19.96 / 20 / 20 (saturates at 99 reviews)
    assert [t[b]["trust_score"] for b in (1, 2, 3)] == [70, 70, 70]
    assert round(min(math.log10(99) * 50, 100) * 0.2, 2) == 19.96


def test_overview_keeps_businesses_without_reviews(shop):
    o = rows_by(O.business_overview(shop, AS_OF), "id")
    assert len(o) == 7
    assert o[2]["trust_score"] is None and o[2]["total_reviews"] is None and o[2]["response_rate"] is None
    assert o[2]["industry_avg_trust"] is not None  # the industry has scored businesses


def test_daily_stats_nulls(shop):
    d = O.daily_stats(shop).filter("business_id = 6").orderBy(F.col("date").asc_nulls_last()).collect()
    assert [r["date"] is None for r in d] == [False, True]  # NULL date group last
    assert d[0]["daily_sentiment"] == 0.0  # (0.2 - 0.2) / 2, NULL ignored
    assert d[-1]["cumulative_reviews"] == 4
    d5 = O.daily_stats(shop).filter("business_id = 5").collect()
    assert [(r["review_count"], r["daily_rating"]) for r in d5] == [(2, 4.0)]  # NULL rating ignored


def test_sentiment_distribution(shop):
    s = rows_by(O.sentiment_distribution(shop, AS_OF), "business_id")
    assert s[2] == {"business_id": 2, "Positive": 0, "Neutral": 0, "Negative": 0}
    # NULL sentiment and exactly +-0.2 are Neutral; the NULL-date review is dropped
    assert s[6] == {"business_id": 6, "Positive": 0, "Neutral": 3, "Negative": 0}
    # 60 x 24 h back from as_of is 2024-05-01 12:00:00, to the microsecond
    assert s[7]["Positive"] == 1 and s[7]["Negative"] == 2


def test_performance_deltas(shop):
    d = rows_by(O.performance_deltas(shop, AS_OF), "business_id")
    assert d[2]["delta_rating"] == 0.0 and d[2]["delta_response_rate"] == 0.0
    assert d[1]["delta_rating"] == 4.0  # only current reviews: delta = current value
    assert d[1]["delta_response_rate"] == pytest.approx(4 / 3)  # mean replies per review
    assert d[1]["delta_neg_sentiment"] == pytest.approx(1 / 3)
    # business 7: current {70}: rating 5; previous {71, 72, 74, 75}: ratings 1, 2, 3, 3
    assert d[7]["delta_rating"] == 5 - (1 + 2 + 3 + 3) / 4
    assert d[7]["delta_neg_sentiment"] == 1.0 - 1 / 4


def test_geo_sentiment_reply_rate(shop):
    g = rows_by(O.geo_sentiment(shop), "location_id")
    assert 2 not in g
    assert g[1]["response_rate"] == pytest.approx(4 / 3)
    assert g[6]["net_sentiment_score"] == pytest.approx((0.2 - 0.2 - 0.9) / 3)


def test_unknown_business_filter_gives_no_rows(shop):
    for df, key in ((O.business_overview(shop, AS_OF), "id"), (O.sentiment_distribution(shop, AS_OF), "business_id")):
        assert df.filter(F.col(key) == 999).count() == 0


def test_monthly_trend(shop):
    m = O.rating_trend_monthly(shop).filter("business_id = 7").collect()
    assert {(r["date"], r["rating"]) for r in m} == {
        (ts("2024-05-01 00:00:00"), (5 + 1 + 2 + 3 + 3) / 5),
        (ts("2024-04-01 00:00:00"), 4.0),
    }


def _locations(spark, counts):
    businesses = [biz(i) for i in range(1, len(counts) + 1)]
    reviews, rid = [], 0
    for b, (n, s) in enumerate(counts, start=1):
        for _ in range(n):
            rid += 1
            reviews.append(review(rid, b, 3, "2024-06-01 00:00:00", s))
    return feedback(spark, businesses, reviews)


@pytest.mark.parametrize("n, slices", [(1, (1, 1)), (4, (1, 2)), (5, (1, 2)), (10, (2, 5))])
def test_geo_insight_slice_sizes(spark, n, slices):
    fb = _locations(spark, [(i + 1, 0.5 if i % 2 else -0.5) for i in range(n)])
    r = O.geo_insight(fb).first()
    assert (r["top_count"], r["bottom_count"]) == slices
    ranked = sorted(range(n), key=lambda i: (-(i + 1), i))
    top = [0.5 if i % 2 else -0.5 for i in ranked[: slices[0]]]
    bottom = [0.5 if i % 2 else -0.5 for i in ranked[-slices[1] :]]
    assert r["top_sentiment"] == pytest.approx(sum(top) / len(top))
    assert r["bottom_sentiment"] == pytest.approx(sum(bottom) / len(bottom))


def test_geo_insight_no_data(spark):
    fb = feedback(spark, [biz(1)], [])
    r = O.geo_insight(fb).first()
    assert r["n_locations"] == 0 and r["insight"] == "Not enough data for insights."


def test_geo_insight_ties_lower_id_first(spark):
    # five locations with equal counts: top slice (1) is the lowest id
    fb = _locations(spark, [(3, 0.9), (3, -0.9), (3, -0.9), (3, -0.9), (3, -0.9)])
    r = O.geo_insight(fb).first()
    assert r["top_sentiment"] == pytest.approx(0.9)
    assert r["bottom_sentiment"] == pytest.approx(-0.9)
    assert r["insight"].startswith("High-volume locations show consistently higher")


def test_report_columns(shop):
    ov = O.business_overview(shop, AS_OF)
    k = rows_by(O.kpi_cards(ov), "business_id")
    assert k[2]["trust_score_text"] == "" and k[2]["rating_text"] == "" and k[2]["response_rate_text"] == "0.0%"
    assert k[1]["response_rate_text"] == "80.0%"
    deltas = O.delta_direction(O.performance_deltas(shop, AS_OF))
    d = rows_by(deltas, "business_id")
    assert d[2]["rating_change"] == "No change" and d[2]["rating_tone"] == "neutral"
    assert d[1]["rating_change"] == "↑ 4.00" and d[1]["rating_tone"] == "positive"
    assert d[1]["sentiment_change"] == "↑ 0.33" and d[1]["sentiment_tone"] == "negative"  # inverse
    assert d[1]["response_change"] == "↑ 133.33"
    bands = rows_by(O.trust_band(O.scored_businesses(shop, AS_OF)), "business_id")
    assert bands[2]["trust_band"] == "bad"


def test_key_checks(spark):
    fb = feedback(
        spark,
        [biz(1), biz(1), biz(2)],
        [review(1, 1, 5, "2024-01-01 00:00:00"), review(2, 9, 5, "2024-01-01 00:00:00"), review(3, None, 1, None)],
        [reply(1, 1), reply(1, 1), reply(2, 77)],
    )
    got = {(r["table_name"], r["rule"]): r["violations"] for r in O.key_checks(fb).collect()}
    assert got[("businesses", "primary key unique")] == 1
    assert got[("responses", "primary key unique")] == 1
    assert got[("reviews", "business_id references businesses")] == 1  # NULL key allowed
    assert got[("responses", "review_id references reviews")] == 1
    assert got[("reviews", "primary key not null")] == 0


def test_day_weight(spark):
    from trustlens.operators.models import day_weight

    rows = [
        (ts("2024-06-29 23:59:00"),),  # late evening the day before: 1 day old
        (ts("2024-06-30 00:00:00"),),
        (ts("2024-07-01 09:00:00"),),  # after as_of: weight above 730
        (ts("2022-06-30 23:59:59"),),  # 731 days: weight 0
        (None,),
    ]
    df = spark.createDataFrame(rows, "created_at timestamp_ntz")
    assert [r[0] for r in df.select(day_weight(AS_OF)).collect()] == [729, 730, 731, 0, 0]


def test_round2_matches_duckdb_round(spark):
    """Two-decimal rounding equals DuckDB's ROUND(x, 2) on 20,000 values, half of them
    decimal midpoints (x.xx5) whose binary value lies just below or above."""
    import random

    import duckdb

    rnd = random.Random(7)
    vals = [rnd.randint(0, 50000) / 10000 for _ in range(10000)]
    vals += [(rnd.randint(0, 5000) * 10 + 5) / 10000 for _ in range(10000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i bigint, x double")
    got = {r[0]: r[1] for r in df.select("i", round2(F.col("x"))).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i BIGINT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(vals)))
    want = dict(con.execute("SELECT i, ROUND(x, 2) FROM t").fetchall())
    assert got == want


def test_js_fixed_rounds_the_exact_binary_value(spark):
    """toFixed semantics: 1.115 is 1.11499..., so 1.11; exact ties (0.125) go up."""
    import random
    from decimal import ROUND_HALF_UP, Decimal

    from trustlens.functions.display import js_fixed

    rnd = random.Random(11)
    vals = [1.115, 0.125, 1.005, 2.675, 0.285, 4.345, -1.115, 0.0, 133.33333333333334]
    vals += [rnd.randint(0, 10**6) / 1000 for _ in range(3000)]
    vals += [(rnd.randint(0, 10**4) * 2 + 1) / 200 for _ in range(3000)]

    def exact(v: float, d: int) -> str:
        q = Decimal(v).copy_abs().quantize(Decimal(1).scaleb(-d), rounding=ROUND_HALF_UP)
        return ("-" if v < 0 else "") + f"{q:.{d}f}"

    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i bigint, x double")
    for d in (1, 2):
        got = {r[0]: r[1] for r in df.select("i", js_fixed(F.col("x"), d)).collect()}
        assert got == {i: exact(v, d) for i, v in enumerate(vals)}
    assert spark.createDataFrame([(None,)], "x double").select(js_fixed(F.col("x"), 2)).first()[0] is None


def test_key_checks_on_empty_tables(spark):
    got = O.key_checks(feedback(spark, [], [], [])).collect()
    assert len(got) == 8 and all(r["violations"] == 0 for r in got)
