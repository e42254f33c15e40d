"""The query contract: every operator as a named query over the driver tables, plus an
independent DuckDB SQL formulation of the same semantics (the correctness oracle).

The oracle SQL is written in a plainer form than the Spark side (reply rates over the
fanned-out LEFT JOIN, one row per review with its period and reply count, a global
ROW_NUMBER for the insight slices), so each Spark rewrite (pre-aggregated and stacked
replies, one-pass periods, radix selection) is checked against the definition.

Both sides round every DOUBLE column to 6 decimals the same way (``round(x * 1e6) /
1e6``), because distributed sums and percentile interpolation may differ in the last
bits from a single-process run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlens import api
from trustlens import operators as O
from trustlens.functions import round_at
from trustlens.plans.incremental import refresh
from trustlens.plans.refresh import json_records, refresh_models
from trustlens.plans.sizing import materialize
from trustlens.schemas import Feedback
from trustlens.session import checkpoint_dir, ensure_checkpoint_dir
from trustlens.sources.fixtures import PROFILES, load_profile
from trustlens.sources.store import FeedbackStore, stack
from trustlens.sources.tables import append_tables, is_empty, read_tables, write_tables

CONTRACT_SCALE = 6


def rounded(df: DataFrame) -> DataFrame:
    """Round every DOUBLE column to the contract scale."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append(round_at(c, CONTRACT_SCALE).alias(f.name) if isinstance(f.dataType, T.DoubleType) else c)
    return df.select(*cols)


# ---------------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------------

Build = Callable[[object, str], DataFrame]  # (Feedback, as_of) -> result


_INPUTS: dict[tuple[int, str, str], tuple] = {}


def _inputs(spark: SparkSession, sf_dir: str, profile: str):
    """The mapped input DataFrames, built once per session, folder and profile (they
    are lazy and immutable, so every query of a session can share them)."""
    key = (id(spark), sf_dir.rstrip("/"), profile)
    if key not in _INPUTS or _INPUTS[key][0].businesses.sparkSession is not spark:
        _INPUTS[key] = load_profile(spark, sf_dir, profile)
    return _INPUTS[key]


def _spark(profile: str, make: Build) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fb, as_of = _inputs(spark, sf_dir, profile)
        return rounded(make(fb, as_of))

    return run


def build(name: str, fb, as_of) -> DataFrame:
    """The contract query ``name`` over given input tables, doubles rounded."""
    return rounded(SPARK_BUILDS[name](fb, as_of))


SPARK_BUILDS: dict[str, Build] = {
    "daily_stats": lambda fb, a: O.daily_stats(fb),
    "trust_score": lambda fb, a: O.trust_score(fb, a),
    "industry_benchmarks": lambda fb, a: O.industry_benchmarks(fb, a),
    "business_overview": lambda fb, a: O.business_overview(fb, a),
    "business_trends": lambda fb, a: O.business_trends(fb),
    "business_benchmark": lambda fb, a: O.business_benchmark(fb, a),
    "sentiment_distribution": lambda fb, a: O.sentiment_distribution(fb, a),
    "performance_deltas": lambda fb, a: O.performance_deltas(fb, a),
    "rating_trend_monthly": lambda fb, a: O.rating_trend_monthly(fb),
    "geo_sentiment": lambda fb, a: O.geo_sentiment(fb),
    "geo_insight": lambda fb, a: O.geo_insight(fb),
    "list_businesses": lambda fb, a: O.list_businesses(fb),
    "trust_band": lambda fb, a: O.trust_band(O.scored_businesses(fb, a)),
    "delta_direction": lambda fb, a: O.delta_direction(O.performance_deltas(fb, a)),
    "geo_markers": lambda fb, a: O.geo_markers(O.geo_sentiment(fb)),
    "geo_extent": lambda fb, a: O.geo_extent(O.geo_markers(O.geo_sentiment(fb))),
    "benchmark_comparison": lambda fb, a: _comparison(fb, a),
    "kpi_cards": lambda fb, a: O.kpi_cards(O.business_overview(fb, a)),
    "key_checks": lambda fb, a: O.key_checks(fb),
}

# The second fixture profile (sub-day timestamps, businesses without reviews, both
# 30-day periods populated) re-runs the time-sensitive operators.
EVENTS_KEYS = (
    "daily_stats",
    "trust_score",
    "industry_benchmarks",
    "business_overview",
    "sentiment_distribution",
    "performance_deltas",
    "delta_direction",
    "geo_sentiment",
    "geo_insight",
    "kpi_cards",
    "key_checks",
)


def _comparison(fb, as_of) -> DataFrame:
    """O17 from one scoring pass: the stored scores give the benchmarks and the rows."""
    scored = materialize(O.scored_businesses(fb, as_of))
    bench = materialize(O.industry_benchmarks(fb, as_of, trust=scored.filter(F.col("total_reviews").isNotNull())))
    return O.benchmark_comparison(scored, bench)


# The ids asked by the look-up entries; the last is in no table.
LOOKUP_IDS = (7, 42, -1)


def _per_id(look_up: Callable) -> Build:
    """The look-up of every id, one below the other."""

    def make(fb, as_of) -> DataFrame:
        out = look_up(fb, LOOKUP_IDS[0], as_of)
        for i in LOOKUP_IDS[1:]:
            out = out.unionByName(look_up(fb, i, as_of))
        return out

    return make


def _folder(fb, name: str) -> str:
    spark = fb.reviews.sparkSession
    ensure_checkpoint_dir(spark)
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stored(fb, as_of) -> DataFrame:
    """The daily series over tables that were written, appended to and read back."""
    root = _folder(fb, "tables")
    even = F.coalesce(F.col("id") % 2 == 0, F.lit(False))  # rows without an id come with the append
    write_tables(Feedback(fb.businesses, fb.reviews.filter(even), fb.responses.filter(even)), root, reviews_by_month=True)
    none = fb.businesses.limit(0)
    append_tables(Feedback(none, fb.reviews.filter(~even), fb.responses.filter(~even)), root, reviews_by_month=True)
    return O.daily_stats(read_tables(fb.reviews.sparkSession, root, reviews_by_month=True))


def _emptiness(fb, as_of) -> DataFrame:
    """Whether each input table is empty, and whether its rows of no id are."""
    spark = fb.reviews.sparkSession
    out = None
    for name in ("businesses", "reviews", "responses"):
        table = getattr(fb, name)
        row = spark.range(1).select(
            F.lit(name).alias("table_name"),
            F.lit(is_empty(table)).alias("is_empty"),
            F.lit(is_empty(table.filter(F.col("id").isNull()))).alias("no_null_id"),
        )
        out = row if out is None else out.unionByName(row)
    return out


_STORES: dict[int, tuple] = {}


def _versions(fb, as_of) -> tuple[FeedbackStore, int, int]:
    """A store with the rows of even ids as one batch, refreshed, and all others as a second one that was
    sent twice, refreshed again; with the versions after either batch. Built once per input tables."""
    if _STORES.get(id(fb), (None,))[0] is not fb:
        store = FeedbackStore.create(fb.reviews.sparkSession, _folder(fb, "store"), rows_per_file=20_000)
        even = F.coalesce(F.col("id") % 2 == 0, F.lit(False))
        first = store.append(Feedback(fb.businesses, fb.reviews.filter(even), fb.responses.filter(even)), "even")
        refresh(store, as_of)
        rest = Feedback(fb.businesses.limit(0), fb.reviews.filter(~even), fb.responses.filter(~even))
        second = store.append(rest, "odd")
        store.append(rest, "odd")
        store.append(Feedback(*[t.filter("id IS NOT NULL") for t in (fb.businesses, rest.reviews, rest.responses)]), "odd again")
        refresh(store, as_of)
        _STORES[id(fb)] = (fb, store, first, second)
    return _STORES[id(fb)][1:]


def _from_store(look_up: Callable) -> Build:
    """The look-up of every id, each over the files that hold the business."""

    def make(fb, as_of) -> DataFrame:
        store = _versions(fb, as_of)[0]
        return stack([look_up(store.of_business([i]), i, as_of) for i in LOOKUP_IDS])

    return make


def history_dates(as_of: str) -> list[date]:
    """24 dates back from the day of ``as_of``, 30 days apart."""
    day = date.fromisoformat(as_of[:10])
    return [day - timedelta(days=30 * i) for i in range(24)]


# The library's sinks, stored models and look-ups (one per route of the reference).
SERVICE_BUILDS: dict[str, Build] = {
    "records_trends": lambda fb, a: json_records(rounded(O.business_trends(fb))),
    "records_monthly": lambda fb, a: json_records(rounded(O.rating_trend_monthly(fb))),
    "lookup_overview": _per_id(lambda fb, i, a: api.business_overview(fb, i, a)),
    "lookup_trends": _per_id(lambda fb, i, a: api.business_trends(fb, i)),
    "lookup_benchmark": _per_id(lambda fb, i, a: api.industry_benchmark(fb, i, a)),
    "lookup_sentiment": _per_id(lambda fb, i, a: api.sentiment_distribution(fb, i, a)),
    "lookup_deltas": _per_id(lambda fb, i, a: api.performance_deltas(fb, i, a)),
    "lookup_monthly": _per_id(lambda fb, i, a: api.rating_trend_monthly(fb, i)),
    "refreshed_benchmarks": lambda fb, a: refresh_models(fb, a, _folder(fb, "models"))["industry_benchmarks"],
    "stored_daily_stats": _stored,
    "emptiness": _emptiness,
    # the versioned store: look-ups by file index, ledger, pinned readers, incremental refresh
    "clustered_trends": _from_store(lambda fb, i, a: api.business_trends(fb, i)),
    "clustered_deltas": _from_store(lambda fb, i, a: api.performance_deltas(fb, i, a)),
    "appended_twice": lambda fb, a: O.geo_sentiment(_versions(fb, a)[0].read()),
    "pinned_daily_stats": lambda fb, a: O.daily_stats(_versions(fb, a)[0].read(_versions(fb, a)[1])),
    "incremental_daily_stats": lambda fb, a: _versions(fb, a)[0].derived("model", "daily_stats"),
    "incremental_trust_score": lambda fb, a: _versions(fb, a)[0].derived("model", "trust_score"),
    "incremental_benchmarks": lambda fb, a: _versions(fb, a)[0].derived("model", "industry_benchmarks"),
    "trust_history": lambda fb, a: O.trust_history(fb, history_dates(a)),
}
SPARK_BUILDS.update(SERVICE_BUILDS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _spark("orders", make) for name, make in SPARK_BUILDS.items()}
    for name in EVENTS_KEYS:
        out[f"{name}_events"] = _spark("events", SPARK_BUILDS[name])
    return out


# ---------------------------------------------------------------------------------
# Oracle side (DuckDB SQL over the raw driver tables)
# ---------------------------------------------------------------------------------

_BUSINESSES = """businesses AS (
  SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, c_mktsegment AS industry, n_name AS location,
         CAST(6.4 AS DOUBLE) + CAST(c_custkey * 37 % 1024 AS DOUBLE) / 4096 AS latitude,
         CAST(3.2 AS DOUBLE) + CAST(c_custkey * 101 % 1024 AS DOUBLE) / 4096 AS longitude
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""

_ORDERS_TABLES = (
    _BUSINESSES
    + """,
reviews AS (
  SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS business_id,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rating, o_orderstatus AS text,
         CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) >= 4
                THEN CAST(0.3125 AS DOUBLE) + CAST(o_orderkey * 7919 % 1024 AS DOUBLE) / 2048
              WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) <= 2
                THEN CAST(-0.875 AS DOUBLE) + CAST(o_orderkey * 7919 % 1024 AS DOUBLE) * 3 / 4096
              ELSE CAST(-0.1875 AS DOUBLE) + CAST(o_orderkey * 7919 % 1024 AS DOUBLE) * 3 / 8192 END
           AS sentiment_score,
         o_orderdate AS created_at
  FROM orders),
responses AS (
  SELECT CAST(l_orderkey * 16 + l_linenumber AS BIGINT) AS id, CAST(l_orderkey AS BIGINT) AS review_id,
         l_returnflag AS response_text, l_shipdate AS responded_at
  FROM lineitem WHERE l_returnflag = 'R')"""
)

_EVENTS_TABLES = (
    _BUSINESSES
    + """,
reviews AS (
  SELECT CAST(event_id AS BIGINT) AS id, CAST(user_id AS BIGINT) AS business_id,
         CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END
           AS rating,
         props AS text,
         CAST(-1 AS DOUBLE) + CAST(event_id * 7919 % 1024 AS DOUBLE) / 512 AS sentiment_score,
         ts AS created_at
  FROM events),
responses AS (
  SELECT CAST(event_id AS BIGINT) AS id, CAST(event_id AS BIGINT) AS review_id, event_type AS response_text,
         ts + INTERVAL 5 HOUR AS responded_at
  FROM events WHERE event_id * 31 % 7 >= 3)"""
)

_TABLES = {"orders": _ORDERS_TABLES, "events": _EVENTS_TABLES}


def _r6(expr: str, name: str) -> str:
    return f"ROUND(({expr}) * CAST(1000000 AS DOUBLE)) / CAST(1000000 AS DOUBLE) AS {name}"


def _ctes(as_of: str) -> dict[str, str]:
    """Named CTEs of the oracle for one as-of instant (``YYYY-MM-DD HH:MM:SS``)."""
    ts = f"TIMESTAMP '{as_of}'"
    day = f"DATE '{as_of[:10]}'"
    weight = f"GREATEST(0, 730 - DATE_DIFF('day', CAST(created_at AS DATE), {day}))"
    return {
        "daily": f"""daily AS (
  SELECT business_id, date, review_count, daily_rating, daily_sentiment,
         CAST(SUM(review_count) OVER w AS BIGINT) AS cumulative_reviews,
         AVG(daily_rating) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_avg_rating
  FROM (SELECT business_id, CAST(created_at AS DATE) AS date, COUNT(*) AS review_count,
               AVG(rating) AS daily_rating, AVG(sentiment_score) AS daily_sentiment
        FROM reviews GROUP BY business_id, CAST(created_at AS DATE)) d
  WINDOW w AS (PARTITION BY business_id ORDER BY date ASC NULLS LAST))""",
        "trust": f"""weights AS (
  SELECT business_id, COUNT(*) AS total_reviews,
         CAST(SUM(rating * {weight}) AS DOUBLE) / CAST(NULLIF(SUM({weight}), 0) AS DOUBLE) AS twr
  FROM reviews GROUP BY business_id),
rates AS (
  SELECT r.business_id, CAST(COUNT(x.id) AS DOUBLE) / CAST(NULLIF(COUNT(r.id), 0) AS DOUBLE) AS rate
  FROM reviews r LEFT JOIN responses x ON r.id = x.review_id GROUP BY r.business_id),
trust AS (
  SELECT b.id AS business_id, b.name, b.industry, w.total_reviews,
         ROUND(w.twr, 2) AS weighted_rating,
         ROUND(COALESCE(t.rate, 0), 2) AS response_rate,
         CAST(w.twr / CAST(5 AS DOUBLE) * 100 * CAST(0.5 AS DOUBLE)
              + COALESCE(t.rate, 0) * 100 * CAST(0.3 AS DOUBLE)
              + LEAST(LOG10(w.total_reviews + 1) * 50, 100) * CAST(0.2 AS DOUBLE) AS INTEGER) AS trust_score
  FROM businesses b JOIN weights w ON b.id = w.business_id LEFT JOIN rates t ON b.id = t.business_id)""",
        "bench": """bench AS (
  SELECT industry,
         PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY weighted_rating) AS p50_rating,
         PERCENTILE_CONT(0.9) WITHIN GROUP (ORDER BY weighted_rating) AS p90_rating,
         PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY trust_score) AS p50_trust_score,
         PERCENTILE_CONT(0.9) WITHIN GROUP (ORDER BY trust_score) AS p90_trust_score,
         AVG(response_rate) AS avg_response_rate
  FROM trust GROUP BY industry)""",
        "overview": """overview AS (
  SELECT b.id, b.name, b.industry, b.location, t.trust_score, t.total_reviews, t.weighted_rating,
         t.response_rate, k.p50_trust_score AS industry_avg_trust, k.p90_trust_score AS industry_top_trust
  FROM businesses b LEFT JOIN trust t ON b.id = t.business_id LEFT JOIN bench k ON b.industry = k.industry)""",
        "bb": """bb AS (
  SELECT b.id AS business_id, k.industry, k.p50_rating, k.p90_rating, k.p50_trust_score, k.p90_trust_score,
         k.avg_response_rate
  FROM businesses b JOIN bench k ON b.industry = k.industry)""",
        "deltas": f"""reply_rows AS (SELECT review_id, COUNT(id) AS n FROM responses GROUP BY review_id),
windowed AS (
  SELECT v.business_id, v.rating, v.sentiment_score, COALESCE(c.n, 0) AS n,
         v.created_at >= {day} - INTERVAL 30 DAY AS is_now
  FROM reviews v LEFT JOIN reply_rows c ON c.review_id = v.id
  WHERE v.id IS NOT NULL AND v.created_at >= {day} - INTERVAL 60 DAY),
sides AS (
  SELECT business_id,
         AVG(rating) FILTER (WHERE is_now) AS rating_now, AVG(rating) FILTER (WHERE NOT is_now) AS rating_then,
         AVG(CASE WHEN sentiment_score < -0.2 THEN 1 ELSE 0 END) FILTER (WHERE is_now) AS neg_now,
         AVG(CASE WHEN sentiment_score < -0.2 THEN 1 ELSE 0 END) FILTER (WHERE NOT is_now) AS neg_then,
         AVG(n) FILTER (WHERE is_now) AS replies_now, AVG(n) FILTER (WHERE NOT is_now) AS replies_then
  FROM windowed GROUP BY business_id),
deltas AS (
  SELECT b.id AS business_id,
         COALESCE(rating_now, 0) - COALESCE(rating_then, 0) AS delta_rating,
         COALESCE(neg_now, 0) - COALESCE(neg_then, 0) AS delta_neg_sentiment,
         COALESCE(replies_now, 0) - COALESCE(replies_then, 0) AS delta_response_rate
  FROM businesses b LEFT JOIN sides ON sides.business_id = b.id)""",
        "sentiment": f"""recent AS (
  SELECT business_id,
         CASE WHEN sentiment_score > 0.2 THEN 'Positive' WHEN sentiment_score < -0.2 THEN 'Negative'
              ELSE 'Neutral' END AS band
  FROM reviews WHERE created_at >= {ts} - INTERVAL 60 DAY),
sentiment AS (
  SELECT b.id AS business_id,
         COUNT(CASE WHEN r.band = 'Positive' THEN 1 END) AS "Positive",
         COUNT(CASE WHEN r.band = 'Neutral' THEN 1 END) AS "Neutral",
         COUNT(CASE WHEN r.band = 'Negative' THEN 1 END) AS "Negative"
  FROM businesses b LEFT JOIN recent r ON b.id = r.business_id GROUP BY b.id)""",
        "geo": """volume AS (
  SELECT business_id, COUNT(id) AS review_count, AVG(rating) AS avg_rating,
         AVG(sentiment_score) AS net_sentiment_score
  FROM reviews GROUP BY business_id),
answered AS (
  SELECT v.business_id, COUNT(*) AS n
  FROM responses a, reviews v WHERE a.review_id = v.id GROUP BY v.business_id),
geo AS (
  SELECT b.id AS location_id, b.name, b.location AS city, b.latitude, b.longitude, review_count, avg_rating,
         net_sentiment_score, CAST(COALESCE(n, 0) AS DOUBLE) / review_count AS response_rate
  FROM volume JOIN businesses b ON b.id = volume.business_id
  LEFT JOIN answered ON answered.business_id = b.id WHERE review_count > 0)""",
        "insight": """ranked AS (
  SELECT net_sentiment_score AS s, ROW_NUMBER() OVER (ORDER BY review_count DESC, location_id ASC) AS rk FROM geo),
sizes AS (
  SELECT COUNT(*) AS n, GREATEST(1, COUNT(*) // 5) AS k_top, GREATEST(1, COUNT(*) // 2) AS k_bottom FROM geo),
slices AS (
  SELECT z.n, z.k_top, z.k_bottom,
         (SELECT AVG(s) FROM ranked WHERE rk <= z.k_top) AS top_sentiment,
         (SELECT AVG(s) FROM ranked WHERE rk > z.n - z.k_bottom) AS bottom_sentiment
  FROM sizes z),
insight AS (
  SELECT n AS n_locations,
         CASE WHEN n > 0 THEN k_top END AS top_count,
         CASE WHEN n > 0 THEN k_bottom END AS bottom_count,
         CASE WHEN n > 0 THEN top_sentiment END AS top_sentiment,
         CASE WHEN n > 0 THEN bottom_sentiment END AS bottom_sentiment,
         CASE WHEN n > 0 THEN top_sentiment - bottom_sentiment END AS sentiment_gap,
         CASE WHEN n = 0 THEN 'Not enough data for insights.'
              WHEN top_sentiment - bottom_sentiment < -0.1
                THEN 'High-volume locations show consistently lower sentiment compared to lower-volume locations.'
              WHEN top_sentiment - bottom_sentiment > 0.1
                THEN 'High-volume locations show consistently higher sentiment compared to lower-volume locations.'
              ELSE 'Sentiment is consistent across both high and low volume locations.' END AS insight
  FROM slices)""",
        "markers": f"""markers AS (
  SELECT location_id, name, review_count, latitude, longitude,
         CASE WHEN net_sentiment_score < -0.1 THEN 'negative' WHEN net_sentiment_score > 0.1 THEN 'positive'
              ELSE 'neutral' END AS band,
         CASE WHEN net_sentiment_score < -0.1 THEN '#ef4444' WHEN net_sentiment_score > 0.1 THEN '#10b981'
              ELSE '#9ca3af' END AS color,
         GREATEST(CAST(5 AS DOUBLE), LN(review_count) * 4) AS radius,
         {_js_fixed("net_sentiment_score", 2)} AS sentiment_text
  FROM geo)""",
        "keys": """pk AS (
  SELECT 'businesses' AS table_name, id FROM businesses
  UNION ALL SELECT 'reviews', id FROM reviews
  UNION ALL SELECT 'responses', id FROM responses),
pk_counts AS (SELECT table_name, id, COUNT(*) AS c FROM pk GROUP BY table_name, id),
keys AS (
  SELECT table_name, 'primary key unique' AS rule,
         CAST(COALESCE(SUM(CASE WHEN id IS NOT NULL AND c > 1 THEN c - 1 END), 0) AS BIGINT) AS violations
  FROM pk_counts GROUP BY table_name
  UNION ALL
  SELECT table_name, 'primary key not null',
         CAST(COALESCE(SUM(CASE WHEN id IS NULL THEN c END), 0) AS BIGINT)
  FROM pk_counts GROUP BY table_name
  UNION ALL
  SELECT 'reviews', 'business_id references businesses', COUNT(*)
  FROM reviews r WHERE r.business_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM businesses b WHERE b.id = r.business_id)
  UNION ALL
  SELECT 'responses', 'review_id references reviews', COUNT(*)
  FROM responses x WHERE x.review_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM reviews r WHERE r.id = x.review_id))""",
    }


def _js_fixed(x: str, digits: int) -> str:
    """JavaScript ``toFixed``: the exact binary value rounded, ties up in magnitude
    (the rounding error of ``x * 10**digits`` recovered with Dekker's exact product)."""
    m = f"CAST({10**digits} AS DOUBLE)"
    a = f"ABS({x})"
    c = f"({a} * CAST(134217729 AS DOUBLE))"
    hi = f"({c} - ({c} - {a}))"
    lo = f"({a} - {hi})"
    s = f"({a} * {m})"
    err = f"(({hi} * {m} - {s}) + {lo} * {m})"
    frac = f"({s} - FLOOR({s}))"
    n = f"(CAST(FLOOR({s}) AS BIGINT) + CASE WHEN {frac} > 0.5 OR ({frac} = 0.5 AND {err} >= 0) THEN 1 ELSE 0 END)"
    p = 10**digits
    return (
        f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || CAST({n} // {p} AS VARCHAR) || '.' "
        f"|| lpad(CAST({n} % {p} AS VARCHAR), {digits}, '0'))"
    )


def _change(value: str, inverse: bool, prefix: str) -> str:
    good = f"{value} < 0" if inverse else f"{value} > 0"
    arrow = f"CASE WHEN {value} > 0 THEN '↑' WHEN {value} < 0 THEN '↓' ELSE '-' END"
    return (
        f"CASE WHEN {value} = 0 THEN 'No change' ELSE {arrow} || ' ' || {_js_fixed(f'ABS({value})', 2)} END"
        f" AS {prefix}_change,\n"
        f"  CASE WHEN {value} = 0 THEN 'neutral' WHEN {good} THEN 'positive' ELSE 'negative' END AS {prefix}_tone"
    )


# name -> (CTEs needed, final SELECT, DOUBLE columns to round)
_FINAL: dict[str, tuple[tuple[str, ...], str, tuple[str, ...]]] = {
    "daily_stats": (
        ("daily",),
        "SELECT business_id, date, review_count, {daily_rating}, {daily_sentiment}, cumulative_reviews, "
        "{running_avg_rating} FROM daily",
        ("daily_rating", "daily_sentiment", "running_avg_rating"),
    ),
    "trust_score": (
        ("trust",),
        "SELECT business_id, name, industry, total_reviews, {weighted_rating}, {response_rate}, trust_score FROM trust",
        ("weighted_rating", "response_rate"),
    ),
    "industry_benchmarks": (
        ("trust", "bench"),
        "SELECT industry, {p50_rating}, {p90_rating}, {p50_trust_score}, {p90_trust_score}, {avg_response_rate} "
        "FROM bench",
        ("p50_rating", "p90_rating", "p50_trust_score", "p90_trust_score", "avg_response_rate"),
    ),
    "business_overview": (
        ("trust", "bench", "overview"),
        "SELECT id, name, industry, location, trust_score, total_reviews, {weighted_rating}, {response_rate}, "
        "{industry_avg_trust}, {industry_top_trust} FROM overview",
        ("weighted_rating", "response_rate", "industry_avg_trust", "industry_top_trust"),
    ),
    "business_trends": (
        ("daily",),
        "SELECT business_id, date, review_count, {daily_rating}, {daily_sentiment}, {running_avg_rating} FROM daily",
        ("daily_rating", "daily_sentiment", "running_avg_rating"),
    ),
    "business_benchmark": (
        ("trust", "bench", "bb"),
        "SELECT business_id, industry, {p50_rating}, {p90_rating}, {p50_trust_score}, {p90_trust_score}, "
        "{avg_response_rate} FROM bb",
        ("p50_rating", "p90_rating", "p50_trust_score", "p90_trust_score", "avg_response_rate"),
    ),
    "sentiment_distribution": (
        ("sentiment",),
        'SELECT business_id, "Positive", "Neutral", "Negative" FROM sentiment',
        (),
    ),
    "performance_deltas": (
        ("deltas",),
        "SELECT business_id, {delta_rating}, {delta_neg_sentiment}, {delta_response_rate} FROM deltas",
        ("delta_rating", "delta_neg_sentiment", "delta_response_rate"),
    ),
    "rating_trend_monthly": (
        (),
        "SELECT business_id, date, {rating}, strftime(date, '%b %y') AS month_label FROM (SELECT business_id, "
        "CAST(DATE_TRUNC('month', created_at) AS TIMESTAMP) AS date, AVG(rating) AS rating FROM reviews "
        "GROUP BY business_id, CAST(DATE_TRUNC('month', created_at) AS TIMESTAMP)) m",
        ("rating",),
    ),
    "geo_sentiment": (
        ("geo",),
        "SELECT location_id, name, city, {latitude}, {longitude}, review_count, {avg_rating}, "
        "{net_sentiment_score}, {response_rate} FROM geo",
        ("latitude", "longitude", "avg_rating", "net_sentiment_score", "response_rate"),
    ),
    "geo_insight": (
        ("geo", "insight"),
        "SELECT n_locations, top_count, bottom_count, {top_sentiment}, {bottom_sentiment}, {sentiment_gap}, insight "
        "FROM insight",
        ("top_sentiment", "bottom_sentiment", "sentiment_gap"),
    ),
    "list_businesses": (
        (),
        "SELECT id, name, industry, name || ' (' || industry || ')' AS label FROM businesses ORDER BY id LIMIT 10",
        (),
    ),
    "trust_band": (
        ("trust", "bench", "overview"),
        "SELECT id AS business_id, trust_score, CASE WHEN trust_score >= 80 THEN 'good' "
        "WHEN trust_score >= 60 THEN 'avg' ELSE 'bad' END AS trust_band FROM overview",
        (),
    ),
    "delta_direction": (
        ("deltas",),
        "SELECT business_id,\n  "
        + _change("delta_rating", False, "rating")
        + ",\n  "
        + _change("delta_neg_sentiment", True, "sentiment")
        + ",\n  "
        + _change("(delta_response_rate * 100)", False, "response")
        + "\nFROM deltas",
        (),
    ),
    "geo_markers": (
        ("geo", "markers"),
        "SELECT location_id, name, review_count, {latitude}, {longitude}, band, color, {radius}, sentiment_text FROM markers",
        ("latitude", "longitude", "radius"),
    ),
    "geo_extent": (
        ("geo", "markers"),
        "SELECT n_markers, {min_latitude}, {max_latitude}, {min_longitude}, {max_longitude} FROM "
        "(SELECT COUNT(*) AS n_markers, MIN(latitude) AS min_latitude, MAX(latitude) AS max_latitude, "
        "MIN(longitude) AS min_longitude, MAX(longitude) AS max_longitude FROM markers) e",
        ("min_latitude", "max_latitude", "min_longitude", "max_longitude"),
    ),
    "benchmark_comparison": (
        ("trust", "bench", "overview", "bb"),
        "SELECT business_id, metric, {this_business}, {industry_p50}, {industry_p90} FROM (\n"
        "  SELECT o.id AS business_id, 'Trust Score' AS metric, CAST(o.trust_score AS DOUBLE) AS this_business,\n"
        "         k.p50_trust_score AS industry_p50, k.p90_trust_score AS industry_p90\n"
        "  FROM overview o JOIN bb k ON o.id = k.business_id\n"
        "  UNION ALL\n"
        "  SELECT o.id, 'Response Rate %', o.response_rate * 100, k.avg_response_rate * 100, CAST(95 AS DOUBLE)\n"
        "  FROM overview o JOIN bb k ON o.id = k.business_id) c",
        ("this_business", "industry_p50", "industry_p90"),
    ),
    "kpi_cards": (
        ("trust", "bench", "overview"),
        "SELECT id AS business_id,\n"
        "  COALESCE(CAST(trust_score AS VARCHAR), '') AS trust_score_text,\n"
        "  CASE WHEN trust_score >= 80 THEN 'good' WHEN trust_score >= 60 THEN 'avg' ELSE 'bad' END AS trust_band,\n"
        "  'Industry Avg: ' || CAST(CAST(FLOOR(COALESCE(industry_avg_trust, 0) + 0.5) AS BIGINT) AS VARCHAR)"
        " AS industry_avg_text,\n"
        "  COALESCE(regexp_replace(" + _js_fixed("weighted_rating", 2) + ", '\\.?0+$', ''), '') AS rating_text,\n"
        "  CASE WHEN total_reviews IS NULL THEN NULL ELSE format('{{:,}}', total_reviews) END AS volume_text,\n"
        "  " + _js_fixed("(COALESCE(response_rate, 0) * 100)", 1) + " || '%' AS response_rate_text\n"
        "FROM overview",
        (),
    ),
    "key_checks": (("keys",), "SELECT table_name, rule, violations FROM keys", ()),
    "emptiness": (
        (),
        "SELECT 'businesses' AS table_name, COUNT(*) = 0 AS is_empty, COUNT(*) = COUNT(id) AS no_null_id FROM businesses "
        "UNION ALL SELECT 'reviews', COUNT(*) = 0, COUNT(*) = COUNT(id) FROM reviews "
        "UNION ALL SELECT 'responses', COUNT(*) = 0, COUNT(*) = COUNT(id) FROM responses",
        (),
    ),
}


def _of_ids(name: str, key: str = "business_id", zeros: str = "") -> tuple[tuple[str, ...], str, tuple[str, ...]]:
    """An operator's SQL for the look-up ids; ``zeros`` answers for an id without a row."""
    needs, final, doubles = _FINAL[name]
    ids = ", ".join(f"({i})" for i in LOOKUP_IDS)
    body = f"SELECT r.* FROM ({final}) r WHERE r.{key} IN (SELECT i FROM (VALUES {ids}) t(i))"
    if zeros:
        body += f" UNION ALL SELECT {zeros} FROM (VALUES {ids}) t(i) WHERE i NOT IN (SELECT id FROM businesses)"
    return needs, body, doubles


_FINAL |= {
    "records_trends": (
        ("daily",),
        "SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date) FROM (" + _FINAL["business_trends"][1] + ") x",
        _FINAL["business_trends"][2],
    ),
    "records_monthly": (
        (),
        "SELECT * REPLACE (strftime(date, '%Y-%m-%dT%H:%M:%S') AS date) FROM (" + _FINAL["rating_trend_monthly"][1] + ") x",
        ("rating",),
    ),
    "lookup_overview": _of_ids("business_overview", "id"),
    "lookup_trends": _of_ids("business_trends"),
    "lookup_benchmark": _of_ids("business_benchmark"),
    "lookup_sentiment": _of_ids("sentiment_distribution", zeros="i, 0, 0, 0"),
    "lookup_deltas": _of_ids("performance_deltas", zeros="i, 0, 0, 0"),
    "lookup_monthly": _of_ids("rating_trend_monthly"),
    "refreshed_benchmarks": _FINAL["industry_benchmarks"],
    "stored_daily_stats": _FINAL["daily_stats"],
    "clustered_trends": _of_ids("business_trends"),
    "clustered_deltas": _of_ids("performance_deltas", zeros="i, 0, 0, 0"),
    "appended_twice": _FINAL["geo_sentiment"],
    "pinned_daily_stats": (
        ("daily_even",),
        _FINAL["daily_stats"][1].replace("FROM daily", "FROM daily_even"),
        _FINAL["daily_stats"][2],
    ),
    "incremental_daily_stats": _FINAL["daily_stats"],
    "incremental_trust_score": _FINAL["trust_score"],
    "incremental_benchmarks": _FINAL["industry_benchmarks"],
}


def table_sql(name: str, as_of: str) -> str:
    """Oracle SQL of one operator over tables named ``businesses``, ``reviews`` and
    ``responses`` (no mapping from the driver tables)."""
    if name == "trust_history":
        days = history_dates(as_of)
        return "\nUNION ALL ".join(f"SELECT DATE '{d}' AS as_of, x.* FROM ({table_sql('trust_score', f'{d}')}) x" for d in days)
    needs, final, doubles = _FINAL[name]
    ctes = _ctes(as_of)
    ctes["daily_even"] = ctes["daily"].replace("daily AS", "daily_even AS").replace("FROM reviews", "FROM reviews WHERE id % 2 = 0")
    body = final.format(**{c: _r6(c, c) for c in doubles}) if doubles else final.replace("{{", "{").replace("}}", "}")
    if not needs:
        return body
    return "WITH " + ",\n".join(ctes[n] for n in needs) + "\n" + body


def _sql(profile: str, name: str) -> str:
    sql = table_sql(name, PROFILES[profile].as_of)
    mapping = _TABLES[profile]
    return f"WITH {mapping},\n{sql[5:]}" if sql.startswith("WITH ") else f"WITH {mapping}\n{sql}"


def oracle_sql() -> dict[str, str]:
    out = {name: _sql("orders", name) for name in SPARK_BUILDS}
    for name in EVENTS_KEYS:
        out[f"{name}_events"] = _sql("events", name)
    return out
