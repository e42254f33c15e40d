"""trustlens: trust metrics for every business at once, as Spark DataFrame jobs.

Three input tables (businesses, reviews, responses) go in; every operator takes
DataFrames plus an explicit ``as_of`` time and returns a DataFrame covering all
businesses. The per-business look-ups of an API are a filter on those results.
"""

from trustlens.schemas import BUSINESSES, RESPONSES, REVIEWS, Feedback

__all__ = ["BUSINESSES", "REVIEWS", "RESPONSES", "Feedback"]
