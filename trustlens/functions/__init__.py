"""Column expressions shared by the operators (all built-in Spark functions)."""

from trustlens.functions.clock import as_of_date, as_of_ts, day_start, days_before
from trustlens.functions.numeric import half_even_int, ratio, round2, round_at

__all__ = [
    "as_of_ts",
    "as_of_date",
    "day_start",
    "days_before",
    "round2",
    "round_at",
    "half_even_int",
    "ratio",
]
