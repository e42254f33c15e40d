"""Batch refresh of the derived tables, the JSON record sink, and a bucketed layout
of the inputs.

- ``refresh_models`` writes the three models in dependency order (daily stats, trust
  score, then industry benchmarks *read back from the written trust table*), so the
  benchmarks never recompute the review aggregation and every reader sees one
  ``as_of``. Output goes under a folder the caller names (on a cluster a shared
  one, e.g. under ``spark.checkpoint.dir``).
- ``json_records`` / ``write_json`` turn dates and timestamps into ISO-8601 text,
  the format of the reference's JSON answers, and write JSON lines.
- ``save_bucketed`` stores the inputs bucketed by the review key (reviews by ``id``,
  replies by ``review_id``), so the review-reply join and the per-review reply
  counts run without shuffling either side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlens.functions.clock import AsOf
from trustlens.operators.models import daily_stats, industry_benchmarks, trust_score
from trustlens.schemas import Feedback
from trustlens.session import shuffle_partitions_for
from trustlens.sources.tables import MONTH_COLUMN, month_of

MODEL_ORDER = ("daily_stats", "trust_score", "industry_benchmarks")


def _path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def refresh_models(fb: Feedback, as_of: AsOf, root: str) -> dict[str, DataFrame]:
    """Materialise O1, O2, O3 under ``root`` (overwrite) and return them read back."""
    spark = fb.reviews.sparkSession
    daily_stats(fb).write.mode("overwrite").parquet(_path(root, "daily_stats"))
    trust_score(fb, as_of).write.mode("overwrite").parquet(_path(root, "trust_score"))
    trust = spark.read.parquet(_path(root, "trust_score"))
    industry_benchmarks(fb, trust=trust).write.mode("overwrite").parquet(_path(root, "industry_benchmarks"))
    return {name: spark.read.parquet(_path(root, name)) for name in MODEL_ORDER}


def register_views(fb: Feedback, as_of: AsOf, prefix: str = "") -> None:
    """Temp views ``<prefix>daily_stats``, ``<prefix>trust_score``,
    ``<prefix>industry_benchmarks`` for SQL users, registered in dependency order; the
    benchmarks view reads the trust view. Views stay lazy: each read recomputes."""
    daily_stats(fb).createOrReplaceTempView(f"{prefix}daily_stats")
    trust_score(fb, as_of).createOrReplaceTempView(f"{prefix}trust_score")
    trust = fb.reviews.sparkSession.table(f"{prefix}trust_score")
    industry_benchmarks(fb, trust=trust).createOrReplaceTempView(f"{prefix}industry_benchmarks")


def json_records(df: DataFrame) -> DataFrame:
    """Dates as ``YYYY-MM-DD``, timestamps as ``YYYY-MM-DDTHH:MM:SS[.ffffff]``."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            c = F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(
                F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            )
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, one record per row, NULLs kept as ``null``."""
    json_records(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def buckets_for(reviews: DataFrame, target_bytes: int = 256 << 20) -> int:
    """Buckets so that one holds about ``target_bytes`` of the reply join's rows (review
    key and business, 32 bytes a review in the row format)."""
    return shuffle_partitions_for(32 * reviews.count(), target_bytes)


def _bucketed(df: DataFrame, mode: str, buckets: int, key: str, table: str, partition: str | None = None) -> None:
    """Write with one task per bucket: Spark deals rows to buckets by the same hash as to
    partitions, so the files are one per bucket (and partition value), however many
    tasks the input has."""
    writer = df.repartition(buckets, key).write.mode(mode)
    if partition:
        writer = writer.partitionBy(partition)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def _save_all(fb: Feedback, prefix: str, mode: str, buckets: int, by_month: bool) -> None:
    conformed = fb.conformed()
    reviews = conformed.reviews
    if by_month:
        reviews = reviews.withColumn(MONTH_COLUMN, month_of(F.col("created_at")))
    _bucketed(conformed.businesses, mode, buckets, "id", f"{prefix}businesses")
    _bucketed(reviews, mode, buckets, "id", f"{prefix}reviews", MONTH_COLUMN if by_month else None)
    _bucketed(conformed.responses, mode, buckets, "review_id", f"{prefix}responses")


def save_bucketed(
    fb: Feedback, spark: SparkSession, prefix: str = "", buckets: int | None = None, reviews_by_month: bool = False
) -> None:
    """Save the inputs as catalog tables ``<prefix>businesses`` etc., reviews and replies
    bucketed (and sorted) on the review key with the same bucket count (from the
    review volume, ``buckets_for``, unless given). With ``reviews_by_month`` the reviews
    are also partitioned by month (buckets within each month), so time windows prune
    months and the reply join stays shuffle-free. Read them back with
    ``read_tables(spark, prefix=prefix)``."""
    _save_all(fb, prefix, "overwrite", buckets or buckets_for(fb.reviews), reviews_by_month)


def append_bucketed(fb: Feedback, spark: SparkSession, prefix: str = "") -> None:
    """Append to tables saved by ``save_bucketed``, in their layout (bucket count and month
    partitions are read from the catalog)."""
    detail = spark.sql(f"DESCRIBE EXTENDED {prefix}reviews").where("col_name = 'Num Buckets'").first()
    by_month = MONTH_COLUMN in spark.table(f"{prefix}reviews").columns
    _save_all(fb, prefix, "append", int(detail["data_type"]), by_month)
