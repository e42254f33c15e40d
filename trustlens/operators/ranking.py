"""Exact top-k / bottom-k slices of a ranked table without a global sort.

O11 needs the mean of a value over the first k rows in the order
``(order_col DESC, id_col ASC)``. A window without PARTITION BY would pull every row
into one task, and ``row_number() OVER (PARTITION BY order_col ...)`` would put a hot
order value (a third of all rows may share one review count) into one task.

Instead each split point is found by selection on histograms, every step of which is
a partial-then-final aggregate:

1. histogram of ``order_col`` (one row per distinct value); running sums over it
   locate the order value holding rank ``r`` and how many of its rows are still
   needed. Its size is the number of distinct order values (for review counts at
   most sqrt(2 x reviews)), never the number of rows.
2. inside that group, radix selection on the id: passes over 16-bit digits of the id
   (sign bit flipped so signed ids order as unsigned keys). High bits shared by every
   id are skipped, so ids below 2**16 need one pass and ids below 2**32 two. Each pass
   aggregates the candidate rows by their next digit (at most 65,536 histogram rows
   per cut), picks the digit holding the needed rank and narrows the prefix. The last
   pass groups by (digit, value), so rows sharing one id (a broken primary key) are
   split exactly, lowest values first.

All cuts advance together: the selection state is a DataFrame with one row per cut,
joined to the rows by a broadcast equi-join (its size is the number of cuts by
construction). Rows before and after each boundary are summed separately (never by
subtraction). The caller passes a materialised key table: the passes re-read it and
must not recompute the upstream aggregation each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT_BITS = 16
DIGIT_MASK = (1 << DIGIT_BITS) - 1
SIGN_BIT = -(1 << 63)
UNSIGNED = (1 << 64) - 1

_TOTALS = ("n", "s", "c")  # rows, sum of non-null values, count of non-null values
_TYPES = {"n": "bigint", "s": "double", "c": "bigint"}
_STATE = ("cut", "st_o", "st_need", "st_prefix", *[f"st_{p}_{t}" for p in ("h", "t") for t in _TOTALS])


def ranking_keys(df: DataFrame, order_col: str, id_col: str, value_col: str) -> DataFrame:
    """(o, u, v): order value, id as an unsigned-ordered key, value."""
    return df.select(
        F.col(order_col).alias("o"),
        F.col(id_col).cast("bigint").bitwiseXOR(F.lit(SIGN_BIT)).alias("u"),
        F.col(value_col).cast("double").alias("v"),
    )


def key_bits(min_u: int, max_u: int) -> int:
    """Low bits in which the keys can differ (signed min/max of ``u`` suffice: keys
    with different top bits make the span 64 bits wide)."""
    return ((min_u ^ max_u) & UNSIGNED).bit_length()


def _passes(bits: int) -> int:
    return max(1, -(-bits // DIGIT_BITS))


def _common_prefix(min_u: int, bits: int) -> int:
    """The high bits shared by every key, above the digits the passes examine."""
    return (min_u & UNSIGNED) >> (DIGIT_BITS * _passes(bits))


def _hist(df: DataFrame, keys: list[Column], carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows, value sum and non-null count per key (``carry`` columns are per-cut constants)."""
    return df.groupBy(*carry, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.count("v").alias("c"))


def _with_running(hist: DataFrame, order: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """Add totals of the histogram rows before (b_*) and after (a_*) each row.

    The windows run over a histogram (partitioned by cut), whose size is bounded as
    described in the module docstring, never over data rows."""
    spec = Window.partitionBy(*by).orderBy(*order)
    before = spec.rowsBetween(Window.unboundedPreceding, -1)
    after = spec.rowsBetween(1, Window.unboundedFollowing)
    cols = [F.col(c) for c in hist.columns]
    for t in _TOTALS:
        zero = F.lit(0).cast(_TYPES[t])
        cols.append(F.coalesce(F.sum(t).over(before), zero).alias(f"b_{t}"))
        cols.append(F.coalesce(F.sum(t).over(after), zero).alias(f"a_{t}"))
    return hist.select(*cols)


def _holds(need: Column) -> Column:
    """The histogram row that holds the ``need``-th row."""
    return (F.col("b_n") < need) & (need <= F.col("b_n") + F.col("n"))


def rank_splits(keyed: DataFrame, cuts: dict[str, int], min_u: int, max_u: int) -> DataFrame:
    """For each cut name -> rank ``r``, totals of ``v`` over the first ``r`` rows (head)
    and the remaining rows (tail) in the order (o DESC, u ASC).

    ``keyed`` comes from ``ranking_keys``; ``min_u`` / ``max_u`` are its (signed) key
    range, from which the skipped common high bits and the passes follow. Returns
    one row per cut with ``0 < r <= rows``: cut, head_n, head_s, head_c, tail_n,
    tail_s, tail_c (rows, value sum, non-null count)."""
    bits = key_bits(min_u, max_u)
    prefix = _common_prefix(min_u, bits)

    # Step 1: the order value that holds each cut's rank.
    running = _with_running(_hist(keyed, [F.col("o").alias("k")]), [F.col("k").desc()])
    states = [
        running.filter(_holds(F.lit(r))).select(
            F.lit(cut).alias("cut"),
            F.col("k").alias("st_o"),
            (F.lit(r) - F.col("b_n")).alias("st_need"),
            F.lit(prefix).cast("bigint").alias("st_prefix"),
            *[F.col(f"b_{t}").alias(f"st_h_{t}") for t in _TOTALS],
            *[F.col(f"a_{t}").alias(f"st_t_{t}") for t in _TOTALS],
        )
        for cut, r in cuts.items()
    ]
    state = states[0]
    for other in states[1:]:
        state = state.unionByName(other)

    # Step 2: radix selection on the id inside each cut's group.
    passes = _passes(bits)
    for p in range(passes):
        last = p == passes - 1
        shift = DIGIT_BITS * (passes - 1 - p)
        st = F.broadcast(state)  # one row per cut
        match = keyed["o"] == st["st_o"]
        if p > 0:
            match = match & (F.shiftrightunsigned(keyed["u"], shift + DIGIT_BITS) == st["st_prefix"])
        cand = keyed.join(st, match, "inner")
        digit = F.shiftrightunsigned("u", shift).bitwiseAND(F.lit(DIGIT_MASK)).alias("k")
        keys = [digit, F.col("v").alias("kv")] if last else [digit]
        order = [F.col("k").asc(), F.col("kv").asc_nulls_last()] if last else [F.col("k").asc()]
        running = _with_running(_hist(cand, keys, _STATE), order, ("cut",))
        edge = running.filter(_holds(F.col("st_need")))
        if not last:
            state = edge.select(
                "cut",
                "st_o",
                (F.col("st_need") - F.col("b_n")).alias("st_need"),
                F.shiftleft("st_prefix", DIGIT_BITS).bitwiseOR(F.col("k")).alias("st_prefix"),
                *[(F.col(f"st_h_{t}") + F.col(f"b_{t}")).alias(f"st_h_{t}") for t in _TOTALS],
                *[(F.col(f"st_t_{t}") + F.col(f"a_{t}")).alias(f"st_t_{t}") for t in _TOTALS],
            )

    # The edge row of the last pass is a run of rows with one id and one value: the
    # first `take` of them belong to the head, the rest to the tail.
    take = F.col("st_need") - F.col("b_n")
    rest = F.col("n") - take
    has_v = F.col("kv").isNotNull()
    zero = F.lit(0.0)
    return edge.select(
        "cut",
        (F.col("st_h_n") + F.col("b_n") + take).alias("head_n"),
        (F.col("st_h_s") + F.col("b_s") + F.when(has_v, F.col("kv") * take).otherwise(zero)).alias("head_s"),
        (F.col("st_h_c") + F.col("b_c") + F.when(has_v, take).otherwise(0)).alias("head_c"),
        (F.col("st_t_n") + F.col("a_n") + rest).alias("tail_n"),
        (F.col("st_t_s") + F.col("a_s") + F.when(has_v, F.col("kv") * rest).otherwise(zero)).alias("tail_s"),
        (F.col("st_t_c") + F.col("a_c") + F.when(has_v, rest).otherwise(0)).alias("tail_c"),
    )
