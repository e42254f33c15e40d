"""The three derived models: daily series (O1), trust score (O2), industry
benchmarks (O3).

Plan shape at scale:
- O1: partial+final aggregate on (business, day), then one shuffle of the *daily*
  rows by business for the running window. A hot business has at most one row per
  day in its window partition, however many reviews it has.
- O2: replies per review (partial agg) joined with the review key and business only;
  those rows stacked on the review rows -> one partial+final aggregate per business
  -> join with businesses on id.
- O3: partial+final aggregate per industry over O2; the exact percentile state is a
  value->count map whose size is bounded by the number of distinct values (at most
  401 two-decimal ratings in 1..5 and 101 integer scores), so hot industries are cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustlens.functions import as_of_date, half_even_int, ratio, round2
from trustlens.functions.clock import AsOf
from trustlens.operators.base import stack_replies
from trustlens.schemas import Feedback

# Fixed values of the trust score: decay horizon in days, component weights, the
# review count at which the volume part saturates (log10(n+1) * 50 capped at 100).
DECAY_DAYS = 730
RATING_WEIGHT = 0.5
RESPONSE_WEIGHT = 0.3
VOLUME_WEIGHT = 0.2
VOLUME_SCALE = 50
VOLUME_CAP = 100


def day_weight(as_of: AsOf, day: Column | None = None) -> Column:
    """Linear decay in whole calendar days, scaled by 730 to stay an integer.

    ``greatest`` skips NULL, so a review without a date weighs 0. A review dated
    after ``as_of`` weighs more than a fresh one (no upper clamp)."""
    age = F.datediff(as_of_date(as_of), F.to_date("created_at") if day is None else day)
    return F.greatest(F.lit(0), F.lit(DECAY_DAYS) - age)


def daily_stats(fb: Feedback) -> DataFrame:
    """O1: per business and calendar day: count, mean rating, mean sentiment, the
    running review count and the running mean of the daily means. A NULL date forms
    its own group, ordered last."""
    daily = fb.reviews.groupBy("business_id", F.to_date("created_at").alias("date")).agg(
        F.count(F.lit(1)).alias("review_count"),
        F.avg("rating").alias("daily_rating"),
        F.avg("sentiment_score").alias("daily_sentiment"),
    )
    return running_series(daily)


def running_series(daily: DataFrame) -> DataFrame:
    """Daily rows with the running review count and the running mean of the daily means."""
    # (business_id, date) is unique after the aggregate, so ROWS equals RANGE here.
    running = (
        Window.partitionBy("business_id")
        .orderBy(F.col("date").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return daily.select(
        "business_id",
        "date",
        "review_count",
        "daily_rating",
        "daily_sentiment",
        F.sum("review_count").over(running).alias("cumulative_reviews"),
        F.avg("daily_rating").over(running).alias("running_avg_rating"),
    )


def business_review_stats(fb: Feedback, as_of: AsOf) -> DataFrame:
    """Per business_id: review count, weighted rating sums and reply counts, from one
    aggregation over the review rows stacked with the replied-review rows.

    ``joined_rows`` is what ``COUNT(review id)`` gives over the LEFT JOIN of reviews and
    replies: one row per review with a non-NULL id, plus the extra rows of reviews with
    several replies."""
    w = day_weight(as_of)
    reviews = fb.reviews.select("id", "business_id", "rating", "created_at")
    stacked = stack_replies(reviews, fb.responses)
    is_reply = F.col("review_row").isNull()
    zero = F.lit(0).cast("bigint")
    agg = stacked.groupBy("business_id").agg(
        F.count("review_row").alias("total_reviews"),
        # NULL ratings drop out of the numerator only, as in SUM(rating*w)/SUM(w).
        F.sum(F.col("rating").cast("bigint") * w).alias("weighted_sum"),
        F.sum(F.when(F.col("review_row").isNotNull(), w)).alias("weight_sum"),
        F.count("id").alias("id_rows"),
        F.count_if(is_reply).alias("replied_rows"),
        F.coalesce(F.sum("replies"), zero).alias("replied"),
        F.coalesce(F.sum("reply_rows"), zero).alias("reply_rows"),
    )
    return agg.select(
        "business_id",
        "total_reviews",
        "weighted_sum",
        "weight_sum",
        "replied",
        (F.col("id_rows") - F.col("replied_rows") + F.col("reply_rows")).alias("joined_rows"),
    )


def scored_businesses(fb: Feedback, as_of: AsOf) -> DataFrame:
    """Every business with its score columns; NULL scores when it has no reviews."""
    return score_stats(fb.businesses, business_review_stats(fb, as_of))


def score_stats(businesses: DataFrame, stats: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every business with the score columns of its sums (``business_review_stats``), and the columns
    ``carry`` of ``stats`` first."""
    b = businesses.select("id", "name", "industry", "location")
    twr = ratio(F.col("weighted_sum"), F.col("weight_sum"))  # NULL when all weights are 0
    rate = F.coalesce(ratio(F.col("replied"), F.col("joined_rows")), F.lit(0.0))
    volume = F.least(F.log10(F.col("total_reviews") + 1) * VOLUME_SCALE, F.lit(VOLUME_CAP))
    score = twr / F.lit(5.0) * 100 * RATING_WEIGHT + rate * 100 * RESPONSE_WEIGHT + volume * VOLUME_WEIGHT
    return (
        b.join(stats, b["id"] == stats["business_id"], "left")
        .select(
            *carry,
            b["id"].alias("business_id"),
            "name",
            "industry",
            "location",
            "total_reviews",
            round2(twr).alias("weighted_rating"),
            F.when(F.col("total_reviews").isNotNull(), round2(rate)).alias("response_rate"),
            half_even_int(score).alias("trust_score"),
        )
    )


TRUST_COLUMNS = ("business_id", "name", "industry", "total_reviews", "weighted_rating", "response_rate", "trust_score")


def trust_score(fb: Feedback, as_of: AsOf = None) -> DataFrame:
    """O2: composite 0..100 trust score for every business with at least one review.

    score = rating part (twr / 5 * 100 * 0.5) + reply part (rate * 100 * 0.3)
            + volume part (min(log10(n + 1) * 50, 100) * 0.2), rounded half to even,
    from unrounded inputs; ``weighted_rating`` and ``response_rate`` are shown rounded
    to two decimals. A business whose reviews are all 730+ days old keeps its row with
    NULL rating and score."""
    return scored_businesses(fb, as_of).filter(F.col("total_reviews").isNotNull()).select(*TRUST_COLUMNS)


def industry_benchmarks(fb: Feedback, as_of: AsOf = None, trust: DataFrame | None = None) -> DataFrame:
    """O3: per industry, exact interpolated P50/P90 of the rounded weighted rating and of
    the trust score, and the unweighted mean of the rounded reply rates."""
    trust = trust if trust is not None else trust_score(fb, as_of)
    agg = trust.groupBy("industry").agg(
        F.percentile("weighted_rating", [0.5, 0.9]).alias("_rating_p"),
        F.percentile("trust_score", [0.5, 0.9]).alias("_score_p"),
        F.avg("response_rate").alias("avg_response_rate"),
    )
    return agg.select(
        "industry",
        F.col("_rating_p")[0].alias("p50_rating"),
        F.col("_rating_p")[1].alias("p90_rating"),
        F.col("_score_p")[0].alias("p50_trust_score"),
        F.col("_score_p")[1].alias("p90_trust_score"),
        "avg_response_rate",
    )
