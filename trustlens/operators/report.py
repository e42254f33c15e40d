"""Display columns the dashboard derives from the query results (O13, O14, O17, O18),
as plain column expressions over the per-business DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlens.functions.display import js_fixed
from trustlens.plans.sizing import broadcast_if_small

# Trust bands (score >= 80 good, >= 60 avg, else bad), change arrows and
# labels, the metric names of the comparison chart and its constant P90 reply rate.
GOOD_FROM = 80
AVG_FROM = 60
UP = "↑"
DOWN = "↓"
FLAT = "-"
NO_CHANGE = "No change"
TRUST_METRIC = "Trust Score"
RESPONSE_METRIC = "Response Rate %"
TOP_RESPONSE_PCT = 95.0


def band_of(score: Column) -> Column:
    """good / avg / bad; a missing score falls in bad."""
    return F.when(score >= GOOD_FROM, "good").when(score >= AVG_FROM, "avg").otherwise("bad")


def trust_band(scored: DataFrame) -> DataFrame:
    """Trust band per business, from ``scored_businesses`` (no benchmark is needed)."""
    return scored.select("business_id", "trust_score", band_of(F.col("trust_score")).alias("trust_band"))


def _change(value: Column, inverse: bool) -> tuple[Column, Column]:
    arrow = F.when(value > 0, UP).when(value < 0, DOWN).otherwise(FLAT)
    text = F.when(value == 0, NO_CHANGE).otherwise(F.concat(arrow, F.lit(" "), js_fixed(F.abs(value), 2)))
    good = value < 0 if inverse else value > 0
    tone = F.when(value == 0, "neutral").when(good, "positive").otherwise("negative")
    return text, tone


def delta_direction(deltas: DataFrame) -> DataFrame:
    """Arrow text and tone per change. A lower negative-sentiment share is good;
    the reply change is shown in percentage points. The arrow follows the sign of the
    unrounded value, so a tiny change prints 0.00 with an arrow."""
    rating_text, rating_tone = _change(F.col("delta_rating"), inverse=False)
    neg_text, neg_tone = _change(F.col("delta_neg_sentiment"), inverse=True)
    resp_text, resp_tone = _change(F.col("delta_response_rate") * 100, inverse=False)
    return deltas.select(
        "business_id",
        rating_text.alias("rating_change"),
        rating_tone.alias("rating_tone"),
        neg_text.alias("sentiment_change"),
        neg_tone.alias("sentiment_tone"),
        resp_text.alias("response_change"),
        resp_tone.alias("response_tone"),
    )


def benchmark_comparison(scored: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Two rows per business with a benchmark: (metric, this business, industry
    P50, industry P90). For replies the "P50" is the industry mean and the P90 is the
    constant 95. ``scored`` is ``scored_businesses``, ``benchmarks`` the materialised
    industry benchmarks: one join, on the industry."""
    bench = broadcast_if_small(
        benchmarks.select(
            F.col("industry").alias("bench_industry"), "p50_trust_score", "p90_trust_score", "avg_response_rate"
        )
    )
    joined = scored.join(bench, scored["industry"] == bench["bench_industry"], "inner")
    rows = F.array(
        F.struct(
            F.lit(TRUST_METRIC).alias("metric"),
            F.col("trust_score").cast("double").alias("this_business"),
            F.col("p50_trust_score").alias("industry_p50"),
            F.col("p90_trust_score").alias("industry_p90"),
        ),
        F.struct(
            F.lit(RESPONSE_METRIC).alias("metric"),
            (F.col("response_rate") * 100).alias("this_business"),
            (F.col("avg_response_rate") * 100).alias("industry_p50"),
            F.lit(TOP_RESPONSE_PCT).alias("industry_p90"),
        ),
    )
    return joined.select("business_id", F.inline(rows))


def kpi_cards(overview: DataFrame) -> DataFrame:
    """The KPI texts of the overview card. Missing values print as the dashboard
    prints them: an empty score, industry average 0, reply rate 0.0%."""
    score = F.col("trust_score")
    # the rating is already rounded to 2 decimals; the dashboard prints its shortest form
    rating = F.regexp_replace(js_fixed(F.col("weighted_rating"), 2), r"\.?0+$", "")
    industry_avg = F.floor(F.coalesce(F.col("industry_avg_trust"), F.lit(0.0)) + 0.5).cast("bigint")
    rate_pct = F.coalesce(F.col("response_rate"), F.lit(0.0)) * 100
    return overview.select(
        F.col("id").alias("business_id"),
        F.coalesce(score.cast("string"), F.lit("")).alias("trust_score_text"),
        band_of(score).alias("trust_band"),
        F.concat(F.lit("Industry Avg: "), industry_avg.cast("string")).alias("industry_avg_text"),
        F.coalesce(rating, F.lit("")).alias("rating_text"),
        F.format_number(F.col("total_reviews"), 0).alias("volume_text"),
        F.concat(js_fixed(rate_pct, 1), F.lit("%")).alias("response_rate_text"),
    )
