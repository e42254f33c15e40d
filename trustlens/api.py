"""Per-business look-ups shaped like the reference's query functions.

Each is the all-business operator over inputs restricted to one business: the id filter
is pushed down to the business and review scans. Replies carry only a review id, so
look-ups that need replies first store the business's review ids and semi-join the
replies to them: the ids are broadcast if they measure small, and the reply scan then
shuffles only this business's replies; otherwise both sides shuffle on the review id.

Unknown ids give no rows, except in the sentiment mix and the changes, which answer zeros.
``as_of=None`` is resolved once per call, so all of a call's queries see one instant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlens import operators as O
from trustlens.functions.clock import AsOf, day_start, fixed_as_of
from trustlens.operators.business import PERIOD_DAYS, SENTIMENT_DAYS
from trustlens.operators.models import TRUST_COLUMNS
from trustlens.plans.sizing import broadcast_if_small, materialize
from trustlens.schemas import Feedback
from trustlens.sources.tables import since


def _clock(fb: Feedback, as_of: AsOf) -> AsOf:
    return fixed_as_of(fb.reviews.sparkSession, as_of)


def _only(fb: Feedback, business_id: int, replies_of: DataFrame | None = None) -> Feedback:
    """Inputs restricted to one business up front, so every scan is filtered. With
    ``replies_of`` (review rows) the replies are restricted to those reviews' replies."""
    reviews = fb.reviews.filter(F.col("business_id") == business_id)
    responses = fb.responses
    if replies_of is not None:
        wanted = replies_of.filter(F.col("business_id") == business_id).select(F.col("id").alias("wanted_id")).distinct()
        wanted = broadcast_if_small(materialize(wanted))
        responses = responses.join(wanted, responses["review_id"] == wanted["wanted_id"], "left_semi")
    return Feedback(fb.businesses.filter(F.col("id") == business_id), reviews, responses)


def _benchmarks(fb: Feedback, as_of: AsOf) -> DataFrame:
    """Industry benchmarks need every business of the industry, so they are computed
    over the full inputs, once (one row per industry), before the size check."""
    return materialize(O.industry_benchmarks(fb, as_of))


def business_overview(
    fb: Feedback, business_id: int, as_of: AsOf = None, benchmarks: DataFrame | None = None
) -> DataFrame:
    """Overview row of one business. Pass the refreshed benchmark table (see
    ``plans.refresh.refresh_models``) to avoid recomputing it per look-up."""
    as_of = _clock(fb, as_of)
    bench = benchmarks if benchmarks is not None else _benchmarks(fb, as_of)
    return O.business_overview(_only(fb, business_id, fb.reviews), as_of, benchmarks=bench)


def business_trends(fb: Feedback, business_id: int) -> DataFrame:
    return O.business_trends(_only(fb, business_id)).orderBy(F.col("date").asc_nulls_last())


def industry_benchmark(
    fb: Feedback, business_id: int, as_of: AsOf = None, benchmarks: DataFrame | None = None
) -> DataFrame:
    bench = benchmarks if benchmarks is not None else _benchmarks(fb, _clock(fb, as_of))
    return O.business_benchmark(_only(fb, business_id), as_of, benchmarks=bench)


def _or_zeros(found: DataFrame, business_id: int) -> DataFrame:
    """The look-up's row, or one row of zeros for an unknown id (a whole-table aggregate
    gives a row in either case)."""
    kinds = dict(found.dtypes)
    values = [c for c in found.columns if c != "business_id"]
    zeros = [F.coalesce(F.max(c), F.lit(0).cast(kinds[c])).alias(c) for c in values]
    return found.agg(*zeros).select(F.lit(business_id).cast("bigint").alias("business_id"), *values)


def sentiment_distribution(fb: Feedback, business_id: int, as_of: AsOf = None, days: int = SENTIMENT_DAYS) -> DataFrame:
    """Positive / Neutral / Negative counts; zeros for an unknown id."""
    return _or_zeros(O.sentiment_distribution(_only(fb, business_id), _clock(fb, as_of), days), business_id)


def performance_deltas(fb: Feedback, business_id: int, as_of: AsOf = None) -> DataFrame:
    """Changes of the last 30 days; zeros for an unknown id."""
    as_of = _clock(fb, as_of)
    recent = since(fb.reviews, day_start(as_of, 2 * PERIOD_DAYS))
    return _or_zeros(O.performance_deltas(_only(fb, business_id, recent), as_of), business_id)


def rating_trend_monthly(fb: Feedback, business_id: int) -> DataFrame:
    """The monthly series in date order, a NULL month last."""
    return O.rating_trend_monthly(_only(fb, business_id)).orderBy(F.col("date").asc_nulls_last())


def trust_score(fb: Feedback, business_id: int, as_of: AsOf = None) -> DataFrame:
    as_of = _clock(fb, as_of)
    return O.trust_score(_only(fb, business_id, fb.reviews), as_of).select(*TRUST_COLUMNS)
