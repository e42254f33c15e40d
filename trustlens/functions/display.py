"""Number-to-text formatting with the dashboard's semantics.

The dashboard prints numbers with JavaScript's ``toFixed(d)``: the *exact* binary value
of the double is rounded to ``d`` decimals, ties going to the larger magnitude. A
shortcut like ``round(x * 10**d)`` differs on values such as 1.115 (stored as
1.11499999...; ``x * 100`` rounds to exactly 111.5). Here the rounding error of the
product ``x * 10**d`` is recovered exactly with Dekker's error-free product (the
multiplier has at most a few significant bits, so both partial products are exact),
and its sign decides only when the rounded product lands exactly on a half. The
digits are then assembled from an integer, so no floating-point formatter is involved.
Everything is plain double arithmetic on columns (whole-stage codegen, no UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLITTER = 134217729.0  # 2**27 + 1, splits a double into two 26-bit halves


def js_fixed(x: Column, digits: int) -> Column:
    """``x.toFixed(digits)`` as text (NULL stays NULL)."""
    scale = float(10**digits)
    a = F.abs(x)
    product = a * scale
    c = a * SPLITTER
    high = c - (c - a)
    low = a - high
    error = (high * scale - product) + low * scale  # exact: a * scale - product
    whole = F.floor(product)
    frac = product - whole
    up = (frac > 0.5) | ((frac == 0.5) & (error >= 0))
    n = whole + F.when(up, 1).otherwise(0)
    p = 10**digits
    return F.when(
        x.isNotNull(),
        F.concat(
            F.when(x < 0, "-").otherwise(""),
            F.floor(n / p).cast("bigint").cast("string"),
            F.lit("."),
            F.lpad((n % p).cast("bigint").cast("string"), digits, "0"),
        ),
    )
