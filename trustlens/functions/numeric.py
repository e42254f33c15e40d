"""Numeric helpers that pin down rounding and division semantics.

- ``round2``: two-decimal rounding of the double *product* ``x * 100`` (half away from
  zero), so 1.005 -> 1.0 and 0.285 -> 0.28, as a C-library ``round(x*100)/100`` gives.
  Spark's own ``round(x, 2)`` rounds the shortest decimal text instead (1.005 -> 1.01).
- ``half_even_int``: double to integer rounding half to even (2.5 -> 2, 3.5 -> 4);
  a plain cast would truncate.
- ``ratio``: division that gives NULL for a zero denominator instead of failing the
  job under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_at(x: Column, scale: int) -> Column:
    factor = float(10**scale)
    return F.round(x * F.lit(factor)) / F.lit(factor)


def round2(x: Column) -> Column:
    return round_at(x, 2)


def half_even_int(x: Column) -> Column:
    return F.rint(x).cast("int")


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
