"""Per-business views (O4-O9, O12), computed for all businesses at once.

The reference answers one business id per call; here each operator returns the rows
of every business, and a caller's look-up is a filter on the result (Catalyst pushes
an id filter down to the scans of both businesses and reviews).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlens.functions import day_start, days_before, ratio
from trustlens.functions.clock import AsOf
from trustlens.operators.base import stack_replies
from trustlens.operators.models import daily_stats, industry_benchmarks, scored_businesses, trust_score
from trustlens.plans.sizing import broadcast_if_small, materialize
from trustlens.schemas import Feedback
from trustlens.sources.tables import since

# Sentiment band edges (exclusive), the sentiment look-back in days and
# the two 30-day comparison periods counted back from the day of as_of.
POSITIVE_ABOVE = 0.2
NEGATIVE_BELOW = -0.2
SENTIMENT_DAYS = 60
PERIOD_DAYS = 30


def business_overview(
    fb: Feedback, as_of: AsOf = None, benchmarks: DataFrame | None = None, scored: DataFrame | None = None
) -> DataFrame:
    """Every business (with or without reviews) with its score columns and its
    industry's median and P90 trust score.

    Without precomputed ``benchmarks`` the per-business scores are materialised once
    and the benchmarks are aggregated from that copy, so the review aggregation runs
    once. The benchmark table (one row per industry) is broadcast after a row-count
    check: a shuffle join on industry would send every business of an industry to one
    task. ``scored`` may pass an already materialised ``scored_businesses`` result."""
    if scored is None:
        scored = scored_businesses(fb, as_of)
        if benchmarks is None:
            scored = materialize(scored)
    if benchmarks is None:
        trust = scored.filter(F.col("total_reviews").isNotNull())
        benchmarks = materialize(industry_benchmarks(fb, as_of, trust=trust))
    bench = broadcast_if_small(
        benchmarks.select(
            F.col("industry").alias("bench_industry"),
            F.col("p50_trust_score").alias("industry_avg_trust"),
            F.col("p90_trust_score").alias("industry_top_trust"),
        )
    )
    return scored.join(bench, scored["industry"] == bench["bench_industry"], "left").select(
        F.col("business_id").alias("id"),
        "name",
        "industry",
        "location",
        "trust_score",
        "total_reviews",
        "weighted_rating",
        "response_rate",
        "industry_avg_trust",
        "industry_top_trust",
    )


def business_trends(fb: Feedback) -> DataFrame:
    """The daily series of O1 without the running count, in date order per business."""
    return daily_stats(fb).select(
        "business_id", "date", "review_count", "daily_rating", "daily_sentiment", "running_avg_rating"
    ).sortWithinPartitions("business_id", F.col("date").asc_nulls_last())


def business_benchmark(fb: Feedback, as_of: AsOf = None, benchmarks: DataFrame | None = None) -> DataFrame:
    """Each business with its industry's benchmark row; no row when its industry
    has no scored business. The benchmark table is materialised (it is tiny) and
    broadcast after a row-count check."""
    if benchmarks is None:
        benchmarks = materialize(industry_benchmarks(fb, as_of))
    bench = broadcast_if_small(benchmarks)
    b = fb.businesses.select(F.col("id").alias("business_id"), F.col("industry").alias("business_industry"))
    return b.join(bench, b["business_industry"] == bench["industry"], "inner").select(
        "business_id",
        "industry",
        "p50_rating",
        "p90_rating",
        "p50_trust_score",
        "p90_trust_score",
        "avg_response_rate",
    )


def sentiment_band(score: F.Column) -> F.Column:
    """Positive above 0.2, Negative below -0.2, Neutral otherwise (NULL included)."""
    return (
        F.when(score > POSITIVE_ABOVE, "Positive").when(score < NEGATIVE_BELOW, "Negative").otherwise("Neutral")
    )


def sentiment_distribution(fb: Feedback, as_of: AsOf = None, days: int = SENTIMENT_DAYS) -> DataFrame:
    """Positive / Neutral / Negative review counts of the last ``days`` x 24 h for
    every business, zero-filled. Counts are conditional aggregates in one pass."""
    s = F.col("sentiment_score")
    recent = since(fb.reviews, days_before(as_of, days))
    counts = recent.groupBy("business_id").agg(
        F.count_if(s > POSITIVE_ABOVE).alias("pos"),
        F.count_if(sentiment_band(s) == "Neutral").alias("neu"),
        F.count_if(s < NEGATIVE_BELOW).alias("neg"),
    )
    b = fb.businesses.select("id")
    return b.join(counts, b["id"] == counts["business_id"], "left").select(
        b["id"].alias("business_id"),
        F.coalesce("pos", F.lit(0)).alias("Positive"),
        F.coalesce("neu", F.lit(0)).alias("Neutral"),
        F.coalesce("neg", F.lit(0)).alias("Negative"),
    )


def performance_deltas(fb: Feedback, as_of: AsOf = None) -> DataFrame:
    """Last 30 days minus the 30 days before, for mean rating, share of negative
    reviews and mean replies per review (may exceed 1). Periods start at midnight. A
    missing period counts as 0; businesses without recent reviews get 0.0 deltas.

    Conditional aggregates over the period rows replace the reference's self-join of
    the period rows with the reply rows; reply sums come from the replied reviews of
    the period, stacked on the period rows for one aggregation."""
    current_from = day_start(as_of, PERIOD_DAYS)
    previous_from = day_start(as_of, 2 * PERIOD_DAYS)
    rows = since(fb.reviews, previous_from).filter(F.col("id").isNotNull()).select(
        "id", "business_id", "rating", "sentiment_score", (F.col("created_at") >= current_from).alias("cur")
    )
    stacked = stack_replies(rows, fb.responses, carry=("business_id", "cur"))
    review = F.col("review_row").isNotNull()
    cur, prev = review & F.col("cur"), review & ~F.col("cur")
    neg = F.col("sentiment_score") < NEGATIVE_BELOW
    zero = F.lit(0).cast("bigint")
    per = stacked.groupBy("business_id").agg(
        F.avg(F.when(cur, F.col("rating"))).alias("cur_rating"),
        F.avg(F.when(prev, F.col("rating"))).alias("prev_rating"),
        ratio(F.count_if(cur & neg), F.count_if(cur)).alias("cur_neg"),
        ratio(F.count_if(prev & neg), F.count_if(prev)).alias("prev_neg"),
        # mean replies per review of the period; reviews without replies count as 0
        ratio(F.coalesce(F.sum(F.when(F.col("cur"), F.col("replies"))), zero), F.count_if(cur)).alias("cur_replies"),
        ratio(F.coalesce(F.sum(F.when(~F.col("cur"), F.col("replies"))), zero), F.count_if(prev)).alias(
            "prev_replies"
        ),
    )
    b = fb.businesses.select("id")
    joined = b.join(per, b["id"] == per["business_id"], "left")

    def delta(name: str) -> F.Column:
        zero = F.lit(0.0)
        return F.coalesce(F.col(f"cur_{name}"), zero) - F.coalesce(F.col(f"prev_{name}"), zero)

    return joined.select(
        b["id"].alias("business_id"),
        delta("rating").alias("delta_rating"),
        delta("neg").alias("delta_neg_sentiment"),
        delta("replies").alias("delta_response_rate"),
    )


def rating_trend_monthly(fb: Feedback) -> DataFrame:
    """Mean rating per business and calendar month (months without reviews are
    absent); ``date`` is the month start as a zone-free timestamp, ``month_label`` its
    chart label (``Jan 24``). In month order per business, a NULL month last."""
    month = F.trunc(F.to_date("created_at"), "month").cast("timestamp_ntz")
    monthly = fb.reviews.groupBy("business_id", month.alias("date")).agg(F.avg("rating").alias("rating"))
    # The aggregate is spread by (business, month); its rows (one per business and month)
    # are brought together by business so that each series is in date order.
    return (
        monthly.select("business_id", "date", "rating", F.date_format("date", "MMM yy").alias("month_label"))
        .repartition("business_id")
        .sortWithinPartitions("business_id", F.col("date").asc_nulls_last())
    )


def list_businesses(fb: Feedback, limit: int = 10) -> DataFrame:
    """The first ``limit`` businesses by id (a top-k, not a full sort), with the
    picker label ``name (industry)``."""
    return (
        fb.businesses.select("id", "name", "industry")
        .orderBy("id")
        .limit(limit)
        .select("id", "name", "industry", F.concat("name", F.lit(" ("), "industry", F.lit(")")).alias("label"))
    )


__all__ = [
    "business_overview",
    "business_trends",
    "business_benchmark",
    "sentiment_distribution",
    "performance_deltas",
    "rating_trend_monthly",
    "list_businesses",
]
