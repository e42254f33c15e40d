"""The analytic operators. Each takes DataFrames (and ``as_of`` where time matters)
and returns a DataFrame.

Most are lazy. ``business_overview`` and ``business_benchmark`` materialise the industry
benchmark table (and the scores it comes from) and measure it before they broadcast it,
unless the caller passes it; ``geo_insight`` materialises its ranking keys and reads one
summary row."""

from trustlens.operators.base import replied_reviews, reply_counts, stack_replies
from trustlens.operators.business import (
    business_benchmark,
    business_overview,
    business_trends,
    list_businesses,
    performance_deltas,
    rating_trend_monthly,
    sentiment_distribution,
)
from trustlens.operators.geo import geo_extent, geo_insight, geo_markers, geo_sentiment
from trustlens.operators.history import trust_history
from trustlens.operators.models import daily_stats, industry_benchmarks, scored_businesses, trust_score
from trustlens.operators.quality import key_checks
from trustlens.operators.ranking import key_bits, rank_splits, ranking_keys
from trustlens.operators.report import benchmark_comparison, delta_direction, kpi_cards, trust_band

__all__ = [
    "reply_counts",
    "replied_reviews",
    "stack_replies",
    "daily_stats",
    "trust_history",
    "trust_score",
    "scored_businesses",
    "industry_benchmarks",
    "business_overview",
    "business_trends",
    "business_benchmark",
    "sentiment_distribution",
    "performance_deltas",
    "rating_trend_monthly",
    "list_businesses",
    "geo_sentiment",
    "geo_insight",
    "geo_markers",
    "geo_extent",
    "key_bits",
    "rank_splits",
    "ranking_keys",
    "trust_band",
    "delta_direction",
    "benchmark_comparison",
    "kpi_cards",
    "key_checks",
]
