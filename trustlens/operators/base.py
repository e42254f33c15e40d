"""Reply counts shared by the reply-based metrics.

Replies carry only a review id, so every reply metric needs one join on the review key.
Two choices keep that join cheap at scale:

- replies are aggregated per review first (map-side partial aggregation, so a review
  with millions of replies never skews a task), which makes the join 1:1 and keeps the
  fan-out of a LEFT JOIN of reviews and replies out of the data;
- only the review key and the grouping columns of the caller cross the join.
  ``stack_replies`` puts the review rows and the replied-review rows in one UNION ALL,
  so ratings, weights, row counts and reply sums come out of a single aggregation
  with one partial-aggregate shuffle, and a filter on the business pushes down into
  both branches.

``replied_reviews`` is an inner join: a review without replies contributes nothing
to reply sums, and a review with a NULL id can never match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reply_counts(responses: DataFrame) -> DataFrame:
    """Replies per review id: reply rows (``COUNT(*)``) and non-null reply ids."""
    return responses.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("reply_rows"),
        F.count("id").alias("replies"),
    )


def replied_reviews(reviews: DataFrame, responses: DataFrame) -> DataFrame:
    """The given review rows that received replies, with ``reply_rows`` and ``replies``.
    Pass ``reviews`` projected to the key and the columns the caller groups by."""
    counts = reply_counts(responses)
    return reviews.join(counts, reviews["id"] == counts["review_id"], "inner").drop("review_id")


def stack_replies(reviews: DataFrame, responses: DataFrame, carry: tuple[str, ...] = ("business_id",)) -> DataFrame:
    """Review rows (``review_row`` = 1, reply columns NULL) stacked on replied-review
    rows (``review_row`` NULL, review columns other than ``carry`` NULL, with
    ``reply_rows`` and ``replies``). Aggregate the result per business: review metrics
    skip the reply rows (their columns are NULL), reply sums skip the review rows."""
    fields = {f.name: f.dataType for f in reviews.schema.fields}
    reply = replied_reviews(reviews.select("id", *carry), responses)
    left = reviews.select(
        *reviews.columns,
        F.lit(1).alias("review_row"),
        F.lit(None).cast("bigint").alias("reply_rows"),
        F.lit(None).cast("bigint").alias("replies"),
    )
    right = reply.select(
        *[F.col(c) if c in carry else F.lit(None).cast(fields[c]).alias(c) for c in reviews.columns],
        F.lit(None).cast("int").alias("review_row"),
        "reply_rows",
        "replies",
    )
    return left.unionByName(right)
