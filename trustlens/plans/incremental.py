"""Incremental, atomic refresh of the derived models of a ``FeedbackStore``.

Two states hold everything the models need, as sums that can be merged:

- ``day_state``: per business and day the number of reviews and the sums and counts of rating and
  sentiment. It gives the daily series, and the weighted rating sums of the trust score at any ``as_of``,
  as the weight of a review depends on its day alone.
- ``reply_state``: per business the replies and the rows of the review-reply join.

A refresh reduces the batches committed since the last one to the same sums, merges them with the stored
states, derives the three models from the states, and commits all five tables as one version. Stored
reviews are never read again, and of the stored replies only two columns of the files
whose review ids meet those that the new replies name (the join counts a review without replies once,
so the first reply to a review changes less than the next), and of replies that
came before their review.

A refresh that fails commits nothing: readers stay at the last version, and the rerun starts from it.

**Cases.** Rows without a business, day, rating or sentiment count as in the full models. A reply to a
review that comes later counts from the refresh that sees the review; a reply to no review
never does. A refresh without new batches rebuilds the models for its ``as_of``
from the states alone. Review ids are taken to be unique (the store keeps an id from being stored twice;
the key check reports repeats within one batch).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from trustlens.functions.clock import AsOf, fixed_as_of
from trustlens.operators.base import reply_counts
from trustlens.operators.models import TRUST_COLUMNS, day_weight, industry_benchmarks, running_series, score_stats
from trustlens.plans.sizing import spread
from trustlens.sources.file_index import between, paths_where, read_files
from trustlens.sources.store import STORED_RESPONSES, FeedbackStore, stack

STATES = ("day_state", "reply_state")
MODELS = ("daily_stats", "trust_score", "industry_benchmarks")
DAY_SUMS = ("review_count", "rating_sum", "rating_count", "sentiment_sum", "sentiment_count")
REPLY_SUMS = ("replied", "joined_rows")


def day_sums(reviews: DataFrame) -> DataFrame:
    """Per business and day: the mergeable sums of the daily series."""
    return reviews.groupBy("business_id", F.to_date("created_at").alias("date")).agg(
        F.count(F.lit(1)).alias("review_count"),
        F.sum(F.col("rating").cast("bigint")).alias("rating_sum"),
        F.count("rating").alias("rating_count"),
        F.sum("sentiment_score").alias("sentiment_sum"),
        F.count("sentiment_score").alias("sentiment_count"),
    )


def reply_sums(reviews: DataFrame, replies: DataFrame, stored: DataFrame) -> DataFrame:
    """Per business, what new reviews and replies add to the replies and to the rows of the review-reply
    join. ``replies`` are the new ones, ``stored`` (id, review_id, business_id) those stored replies that share
    a review id with a new reply or that came before their review."""
    keyed = reviews.select("id", "business_id").where(F.col("id").isNotNull())
    # new reviews, with new replies and with those that came before them
    early = stored.where(F.col("business_id").isNull())
    counts = reply_counts(replies.select("id", "review_id").unionByName(early.select("id", "review_id")))
    fresh = keyed.join(spread(counts), keyed["id"] == counts["review_id"], "left").select(
        "business_id",
        F.coalesce("replies", F.lit(0)).alias("replied"),
        F.greatest(F.lit(1), F.coalesce("reply_rows", F.lit(0))).alias("joined_rows"),
    )
    # new replies to stored reviews: the first reply takes the place of the review's own row
    ours = keyed.select(F.col("id").alias("own_id"))
    late = replies.where(F.col("business_id").isNotNull()).select("id", "review_id", "business_id")
    late = late.join(spread(ours), late["review_id"] == ours["own_id"], "left_anti")
    late = late.groupBy("review_id", "business_id").agg(F.count(F.lit(1)).alias("rows"), F.count("id").alias("replied"))
    had = stored.groupBy(F.col("review_id").alias("of_id")).agg(F.count(F.lit(1)).alias("had"))
    before = F.greatest(F.lit(1), F.coalesce("had", F.lit(0)))
    later = late.join(spread(had), late["review_id"] == had["of_id"], "left").select(
        "business_id", "replied", (F.greatest(F.lit(1), F.coalesce("had", F.lit(0)) + F.col("rows")) - before).alias("joined_rows")
    )
    return _merged(fresh.unionByName(later), ("business_id",), REPLY_SUMS)


def _merged(rows: DataFrame, keys: tuple[str, ...], sums: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).cast(dict(rows.dtypes)[c]).alias(c) for c in sums])


def stored_replies(store: FeedbackStore, replies: DataFrame, covered: list[Row]) -> DataFrame:
    """The stored replies that a refresh reads: those whose review id is also a new reply's, and those whose
    business was not known, from files that the index names."""
    if not covered:
        return replies.limit(0).select("id", "review_id", "business_id")
    index = store.index("responses", covered)
    low, high = replies.agg(F.min("review_id"), F.max("review_id")).first()
    paths = paths_where(index, F.coalesce(between("review_id", low, high), F.lit(False)) | (F.col("null_keys") > 0))
    found = read_files(store.spark, STORED_RESPONSES, paths).select("id", "review_id", "business_id")
    named = replies.select(F.col("review_id").alias("new_id")).where(F.col("new_id").isNotNull()).distinct()
    same = found.join(spread(named), found["review_id"] == named["new_id"], "left_semi")
    return same.where(F.col("business_id").isNotNull()).unionByName(found.where(F.col("business_id").isNull()))


def deltas(store: FeedbackStore, new: list[Row], covered: list[Row]) -> tuple[DataFrame, DataFrame]:
    """The sums of the new batches for both states."""
    reviews, replies = store.rows("reviews", new), store.rows("responses", new)
    return day_sums(reviews), reply_sums(reviews, replies, stored_replies(store, replies, covered))


def daily_from(days: DataFrame) -> DataFrame:
    """O1 from the day state."""
    daily = days.select(
        "business_id", "date", "review_count",
        F.try_divide(F.col("rating_sum").cast("double"), F.col("rating_count")).alias("daily_rating"),
        F.try_divide("sentiment_sum", "sentiment_count").alias("daily_sentiment"),
    )
    return running_series(daily)


def stats_from(days: DataFrame, replies: DataFrame, as_of: AsOf) -> DataFrame:
    """The per-business sums of the trust score (``models.business_review_stats``) from the states."""
    w = day_weight(as_of, F.col("date"))
    rated = days.groupBy("business_id").agg(
        F.sum("review_count").alias("total_reviews"),
        F.sum(F.col("rating_sum") * w).alias("weighted_sum"),
        F.sum(F.col("review_count") * w).alias("weight_sum"),
    )
    answered = replies.withColumnRenamed("business_id", "of_id")
    joined = rated.join(spread(answered), rated["business_id"].eqNullSafe(answered["of_id"]), "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(*rated.columns, *[F.coalesce(c, zero).alias(c) for c in REPLY_SUMS])


def refresh(store: FeedbackStore, as_of: AsOf = None) -> int:
    """Bring states and models up to the latest batch and commit them; returns the new version."""
    as_of = fixed_as_of(store.spark, as_of)
    through = store.version()
    last = store.latest("state", STATES[0])
    covered = store.batches(last["through"]) if last else []
    new = store.batches(through, after=last["through"] if last else 0)
    folder = f"derived/{uuid.uuid4().hex}"
    path = {name: f"{store.root}/{folder}/{name}" for name in (*STATES, *MODELS)}

    def read(name: str) -> DataFrame:
        return store.spark.read.parquet(path[name])

    added = deltas(store, new, covered) if new or not last else (None, None)
    groups = (("business_id", "date"), DAY_SUMS), (("business_id",), REPLY_SUMS)
    for name, part, (keys, sums) in zip(STATES, added, groups):
        frames = [part] if part is not None else []
        frames += [store.derived("state", name)] if last else []
        _merged(stack(frames), keys, sums).write.parquet(path[name])
    daily_from(read("day_state")).write.parquet(path["daily_stats"])
    businesses = store.read(through).businesses
    scored = score_stats(businesses, spread(stats_from(read("day_state"), read("reply_state"), as_of)))
    scored.filter(F.col("total_reviews").isNotNull()).select(*TRUST_COLUMNS).write.parquet(path["trust_score"])
    industry_benchmarks(None, trust=read("trust_score")).write.parquet(path["industry_benchmarks"])
    kinds = [("state", name) for name in STATES] + [("model", name) for name in MODELS]
    return store.commit([(kind, name, f"{folder}/{name}", through) for kind, name in kinds])
