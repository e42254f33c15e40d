"""The trust score at many dates from one pass over the reviews.

The weight of a review falls by one a day until it is 0 at ``DECAY_DAYS``, so with ``edge`` = the day of
``as_of`` minus ``DECAY_DAYS`` the weighted sums of a business are

    sum over days d > edge of (d - edge) * x_d  =  (D - D_edge) - edge * (X - X_edge)

where x_d are a day's review count or rating sum, X and D the sums of x_d and d * x_d over all days, and
X_edge, D_edge the same over the days up to the edge: prefix sums, looked up at the edge.

Plan: reviews stacked with replied reviews as in O2, one partial-then-final aggregate per (business, day);
one shuffle of those daily rows by business for the totals, the prefix sums and the look-up. A business has at
most one row per day and date in its window partition, however many reviews it has. Reviews and
replies are read once, whatever the number of dates. All sums are integers.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustlens.operators.base import stack_replies
from trustlens.operators.models import DECAY_DAYS, TRUST_COLUMNS, score_stats
from trustlens.schemas import Feedback

_SUMS = ("n", "day_n", "rated", "day_rated")


def _daily(fb: Feedback) -> DataFrame:
    """Per business and day (null: reviews without a date, and the replies): the sums of O2."""
    stacked = stack_replies(fb.reviews.select("id", "business_id", "rating", "created_at"), fb.responses)
    return stacked.groupBy("business_id", F.datediff(F.to_date("created_at"), F.lit("1970-01-01").cast("date")).alias("day")).agg(
        F.count("review_row").alias("n"),
        F.coalesce(F.sum(F.col("rating").cast("bigint")), F.lit(0)).alias("rated"),
        F.count("rating").alias("ratings"),
        F.count("id").alias("id_rows"),
        F.count_if(F.col("review_row").isNull()).alias("replied_rows"),
        F.coalesce(F.sum("replies"), F.lit(0)).alias("replies"),
        F.coalesce(F.sum("reply_rows"), F.lit(0)).alias("reply_rows"),
    )


def trust_history(fb: Feedback, dates: Sequence[date]) -> DataFrame:
    """O2 at each of ``dates``: as_of and the columns of the trust score, one row per date and business with
    reviews. As in O2, reviews and replies of all time count towards volume and reply rate at
    every date. Repeated dates give one row each time; no dates give no rows."""
    daily = _daily(fb).withColumn("day_n", F.col("day") * F.col("n")).withColumn("day_rated", F.col("day") * F.col("rated"))
    whole = Window.partitionBy("business_id")
    upto = whole.orderBy(F.col("day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dated = F.col("day").isNotNull()
    total = lambda c: F.sum(c).over(whole)
    summed = daily.select(
        "business_id",
        "day",
        *[F.sum(F.when(dated, F.col(c))).over(upto).alias(f"{c}_upto") for c in _SUMS],
        *[F.coalesce(total(F.when(dated, F.col(c))), F.lit(0)).alias(f"{c}_all") for c in _SUMS],
        total("n").alias("total_reviews"),
        total("ratings").alias("all_ratings"),
        total("replies").alias("replied"),
        (total("id_rows") - total("replied_rows") + total("reply_rows")).alias("joined_rows"),
        F.row_number().over(whole.orderBy(F.col("day").asc_nulls_first())).alias("nth"),
    )
    # every date as a row of its own at its edge, after the days up to the edge (made from a business's
    # first row, so that the daily rows are read once)
    none = F.array(F.lit(None).cast("date"))
    asked = F.array(*[F.lit(d).cast("date") for d in dates]).cast("array<date>")
    rows = summed.withColumn("as_of", F.explode(F.when(F.col("nth") == 1, F.concat(none, asked)).otherwise(none)))
    edge = F.datediff(F.col("as_of"), F.lit("1970-01-01").cast("date")) - DECAY_DAYS
    own = F.col("as_of").isNull()
    kept = [f"{c}_all" for c in _SUMS] + ["total_reviews", "all_ratings", "replied", "joined_rows"]
    upto_own = [F.when(own, F.col(f"{c}_upto")).alias(f"{c}_upto") for c in _SUMS]
    stacked = rows.select("business_id", F.when(own, F.col("day")).otherwise(edge).alias("day"), "as_of", *upto_own, *kept)
    before = whole.orderBy(F.col("day").asc_nulls_first(), F.col("as_of").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = [F.coalesce(F.last(f"{c}_upto", ignorenulls=True).over(before), F.lit(0)).alias(f"{c}_upto") for c in _SUMS]
    at = stacked.select("business_id", "day", "as_of", *found, *kept).where(F.col("as_of").isNotNull())

    def weighted(c: str):
        return F.col(f"day_{c}_all") - F.col(f"day_{c}_upto") - F.col("day") * (F.col(f"{c}_all") - F.col(f"{c}_upto"))

    stats = at.select(
        "as_of",
        "business_id",
        "total_reviews",
        F.when(F.col("all_ratings") > 0, weighted("rated")).alias("weighted_sum"),
        weighted("n").alias("weight_sum"),
        "replied",
        "joined_rows",
    )
    return score_stats(fb.businesses, stats, ("as_of",)).filter(F.col("total_reviews").isNotNull()).select("as_of", *TRUST_COLUMNS)
