"""Geographic views: per-location sentiment (O10), the volume-vs-sentiment insight
(O11), map markers (O15) and their extent (O16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlens.functions import ratio
from trustlens.functions.display import js_fixed
from trustlens.operators.base import replied_reviews
from trustlens.operators.ranking import rank_splits, ranking_keys
from trustlens.plans.sizing import materialize
from trustlens.schemas import Feedback

# Slice fractions of the insight (top 20 % vs bottom 50 % by review count,
# each at least one location), its significance threshold, and its four sentences.
TOP_DIVISOR = 5
BOTTOM_DIVISOR = 2
INSIGHT_THRESHOLD = 0.1
NO_DATA = "Not enough data for insights."
LOWER = "High-volume locations show consistently lower sentiment compared to lower-volume locations."
HIGHER = "High-volume locations show consistently higher sentiment compared to lower-volume locations."
CONSISTENT = "Sentiment is consistent across both high and low volume locations."

# Marker colours (positive, neutral, negative), the marker band edge and
# the radius rule max(5, ln(review_count) * 4).
POSITIVE_COLOR = "#10b981"
NEUTRAL_COLOR = "#9ca3af"
NEGATIVE_COLOR = "#ef4444"
MARKER_BAND = 0.1
MIN_RADIUS = 5
RADIUS_SCALE = 4


def geo_sentiment(fb: Feedback) -> DataFrame:
    """Per business with at least one review: coordinates, review count, mean
    rating, mean sentiment and replies per review (counted through the review's
    business; may exceed 1).

    Reviews and replies are aggregated per business separately and the reply counts
    are left-joined. A caller that drops ``response_rate`` (markers, extent, ranking
    keys) thereby drops the whole reply side: the right side's key is unique, so
    Catalyst removes the join, and the plan reads the reviews once and no replies."""
    per = fb.reviews.groupBy("business_id").agg(
        F.count("id").alias("review_count"),
        F.avg("rating").alias("avg_rating"),
        F.avg("sentiment_score").alias("net_sentiment_score"),
    )
    per = per.filter(F.col("review_count") > 0)
    replied = replied_reviews(fb.reviews.select("id", "business_id"), fb.responses)
    replies = replied.groupBy(F.col("business_id").alias("replied_id")).agg(F.sum("reply_rows").alias("reply_rows"))
    per = per.join(replies, per["business_id"] == replies["replied_id"], "left")
    per = per.withColumn("reply_count", F.coalesce("reply_rows", F.lit(0).cast("bigint")))
    b = fb.businesses.select("id", "name", "location", "latitude", "longitude")
    return b.join(per, b["id"] == per["business_id"], "inner").select(
        b["id"].alias("location_id"),
        "name",
        F.col("location").alias("city"),
        "latitude",
        "longitude",
        "review_count",
        "avg_rating",
        "net_sentiment_score",
        ratio(F.col("reply_count"), F.col("review_count")).alias("response_rate"),
    )


def geo_insight(fb: Feedback, geo: DataFrame | None = None) -> DataFrame:
    """One row comparing the mean sentiment of the top 20 % of locations by review
    count with the bottom 50 % (ties in review count: lower id ranks first).

    The per-location keys (review count, id, sentiment) are checkpointed once to the
    session's checkpoint folder, so the selection passes re-read that small table
    instead of recomputing the review aggregation, and the lineage is cut. One summary
    row (count, sums, key range) then sizes the slices. Slices are found by exact
    distributed selection (``rank_splits``), not by sorting all locations in one task.
    Locations with a NULL mean sentiment count in the slice sizes but not in the means."""
    geo = geo if geo is not None else geo_sentiment(fb)
    keyed = materialize(ranking_keys(geo, "review_count", "location_id", "net_sentiment_score"))
    size = keyed.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("v"), F.lit(0.0)).alias("all_s"),
        F.count("v").alias("all_c"),
        F.min("u").alias("min_u"),
        F.max("u").alias("max_u"),
    ).first()
    n = size["n"]
    carrier = keyed.agg(F.count(F.lit(1)).alias("n_locations"))
    if n == 0:
        none = [F.lit(None).cast(t).alias(c) for c, t in _INSIGHT_NUMBERS]
        return carrier.select("n_locations", *none, F.lit(NO_DATA).alias("insight"))

    k_top = max(1, n // TOP_DIVISOR)
    k_bottom = max(1, n // BOTTOM_DIVISOR)
    cuts = {"top": k_top}
    if n - k_bottom > 0:
        cuts["bottom"] = n - k_bottom
    splits = rank_splits(keyed, cuts, size["min_u"], size["max_u"])
    is_top, is_bottom = F.col("cut") == "top", F.col("cut") == "bottom"
    slices = splits.agg(
        F.max(F.when(is_top, F.col("head_s"))).alias("top_s"),
        F.max(F.when(is_top, F.col("head_c"))).alias("top_c"),
        F.max(F.when(is_bottom, F.col("tail_s"))).alias("bottom_s"),
        F.max(F.when(is_bottom, F.col("tail_c"))).alias("bottom_c"),
    )
    top_mean = ratio(F.col("top_s"), F.col("top_c"))
    if "bottom" in cuts:
        bottom_mean = ratio(F.col("bottom_s"), F.col("bottom_c"))
    else:  # the bottom slice is every location (n = 1)
        bottom_mean = ratio(F.lit(size["all_s"]), F.lit(size["all_c"]))
    gap = top_mean - bottom_mean
    insight = (
        F.when(gap < -INSIGHT_THRESHOLD, F.lit(LOWER))
        .when(gap > INSIGHT_THRESHOLD, F.lit(HIGHER))
        .otherwise(F.lit(CONSISTENT))
    )
    return slices.select(
        F.lit(n).cast("bigint").alias("n_locations"),
        F.lit(k_top).cast("bigint").alias("top_count"),
        F.lit(k_bottom).cast("bigint").alias("bottom_count"),
        top_mean.alias("top_sentiment"),
        bottom_mean.alias("bottom_sentiment"),
        gap.alias("sentiment_gap"),
        insight.alias("insight"),
    )


_INSIGHT_NUMBERS = (
    ("top_count", "bigint"),
    ("bottom_count", "bigint"),
    ("top_sentiment", "double"),
    ("bottom_sentiment", "double"),
    ("sentiment_gap", "double"),
)


def geo_markers(geo: DataFrame) -> DataFrame:
    """Map marker per location: sentiment band at +-0.1, its colour, a radius
    growing with the log of the review count, and the popup's name, review count and
    sentiment text."""
    s = F.col("net_sentiment_score")
    band = F.when(s < -MARKER_BAND, "negative").when(s > MARKER_BAND, "positive").otherwise("neutral")
    color = F.when(s < -MARKER_BAND, NEGATIVE_COLOR).when(s > MARKER_BAND, POSITIVE_COLOR).otherwise(NEUTRAL_COLOR)
    radius = F.greatest(F.lit(float(MIN_RADIUS)), F.ln(F.col("review_count")) * RADIUS_SCALE)
    return geo.select(
        "location_id",
        "name",
        "review_count",
        "latitude",
        "longitude",
        band.alias("band"),
        color.alias("color"),
        radius.alias("radius"),
        js_fixed(s, 2).alias("sentiment_text"),
    )


def geo_extent(markers: DataFrame) -> DataFrame:
    """Bounding box of all markers (one row; NULL box when there are none)."""
    return markers.agg(
        F.count(F.lit(1)).alias("n_markers"),
        F.min("latitude").alias("min_latitude"),
        F.max("latitude").alias("max_latitude"),
        F.min("longitude").alias("min_longitude"),
        F.max("longitude").alias("max_longitude"),
    )
