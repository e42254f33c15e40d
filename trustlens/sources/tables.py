"""Scans and sinks for the three input tables (Parquet folders or catalog tables).

Reads always apply the explicit schema, so no inference pass runs over the files and
column pruning / filter pushdown reach the Parquet scan.

Reviews may be stored partitioned by calendar month of ``created_at``
(``reviews_by_month=True``): the folder then carries a ``created_month`` partition
column (``yyyy-MM`` text), and the time-window operators (O7, O8) add a predicate on
it, so Spark lists and opens only the last months' files instead of every footer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlens.schemas import SCHEMAS, Feedback, conform

TABLE_NAMES = ("businesses", "reviews", "responses")
MONTH_COLUMN = "created_month"
MONTH_FORMAT = "yyyy-MM"


def _with_month(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(MONTH_COLUMN, T.StringType())])


def read_tables(
    spark: SparkSession, root: str | None = None, fmt: str = "parquet", prefix: str = "", reviews_by_month: bool = False
) -> Feedback:
    """Scan ``root/<name>`` folders, or catalog tables ``<prefix><name>`` when no root is
    given. ``reviews_by_month`` reads the month-partitioned review layout."""
    frames = {}
    for name in TABLE_NAMES:
        if root is None:
            table = spark.table(f"{prefix}{name}")
            schema = SCHEMAS[name]
            if name == "reviews" and MONTH_COLUMN in table.columns:
                # keep the partition column: the time-window operators prune on it
                schema = _with_month(schema)
            df = conform(table, schema)
        else:
            path = f"{root.rstrip('/')}/{name}"
            schema = SCHEMAS[name]
            if name == "reviews" and reviews_by_month:
                schema = _with_month(schema)
            df = spark.read.schema(schema).format(fmt).load(path)
        frames[name] = df
    return Feedback(**frames)


def month_of(ts: Column) -> Column:
    """The ``created_month`` value of a timestamp."""
    return F.date_format(ts, MONTH_FORMAT)


def since(reviews: DataFrame, lower: Column) -> DataFrame:
    """Reviews with ``created_at >= lower``; on a month-partitioned table the same bound
    is also applied to the partition column, which prunes whole months."""
    out = reviews.filter(F.col("created_at") >= lower)
    if MONTH_COLUMN in reviews.columns:
        out = out.filter(F.col(MONTH_COLUMN) >= month_of(lower))
    return out


def _write(fb: Feedback, root: str, mode: str, fmt: str, reviews_by_month: bool) -> None:
    conformed = fb.conformed()
    # The order mirrors the key dependencies (businesses <- reviews <- responses).
    for name in TABLE_NAMES:
        df = getattr(conformed, name)
        writer = df.write.mode(mode).format(fmt)
        if name == "reviews" and reviews_by_month:
            # Months are gathered before writing (AQE splits large ones and merges small
            # ones), so files follow the volume of a month, not the input's tasks.
            by_month = df.withColumn(MONTH_COLUMN, month_of(F.col("created_at"))).hint("rebalance", MONTH_COLUMN)
            writer = by_month.write.mode(mode).format(fmt).partitionBy(MONTH_COLUMN)
        writer.save(f"{root.rstrip('/')}/{name}")


def write_tables(fb: Feedback, root: str, fmt: str = "parquet", reviews_by_month: bool = False) -> None:
    """Drop-and-recreate load: replace all three tables."""
    _write(fb, root, "overwrite", fmt, reviews_by_month)


def append_tables(fb: Feedback, root: str, fmt: str = "parquet", reviews_by_month: bool = False) -> None:
    """Bulk append of new rows to the three tables (same layout as when written)."""
    _write(fb, root, "append", fmt, reviews_by_month)


def is_empty(df: DataFrame) -> bool:
    """Whether a table has no rows (stops at the first row found)."""
    return df.isEmpty()
