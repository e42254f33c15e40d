"""Small helpers shared by the operators."""

from __future__ import annotations

import pkgutil
import gc
import sys
import uuid
from functools import lru_cache
from importlib import import_module

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trustlens.plans.sizing import MAX_BROADCAST_ROWS, materialize
from trustlens.session import checkpoint_dir

#: A word: a maximal run of characters that are not ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


@lru_cache(maxsize=1)
def ship_code() -> None:
    """Make Spark send this subpackage's functions to the executors by value, so that
    Python workers need no copy of the repository on their path."""
    package = sys.modules[__package__]
    for info in pkgutil.iter_modules(package.__path__):
        cloudpickle.register_pickle_by_value(import_module(f"{__package__}.{info.name}"))


def materialize_counted(df: DataFrame, *measures: Column) -> tuple[DataFrame, tuple]:
    """``df`` computed once into the checkpoint folder, with aggregates over its rows that Spark
    takes along the way (no second job)."""
    seen = Observation()
    stored = materialize(df.observe(seen, *(m.alias(f"m{i}") for i, m in enumerate(measures))))
    return stored, tuple(seen.get[f"m{i}"] for i in range(len(measures)))


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the shuffle files of finished steps now. It does so for results that
    neither Python nor the driver's JVM references any more, but learns of them only from a
    garbage collection, which a long loop of small jobs may not cause for a while."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.coalesce(F.array_remove(F.split(text, SPACE), ""), F.array().cast("array<string>"))


def code_points_order(column: Column) -> Column:
    """Ascending sort key by code point, null last (Spark compares UTF-8 bytes, which is
    code point order)."""
    return column.asc_nulls_last()


def stored_side(df: DataFrame) -> DataFrame:
    """A join side computed once, broadcast if it is counted to hold few rows."""
    stored, (n,) = materialize_counted(df, F.count(F.lit(1)))
    return F.broadcast(stored) if n <= MAX_BROADCAST_ROWS else stored


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, for one run's files."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored_table(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once as Parquet and read back: cuts lineage like ``materialize``, in a
    fraction of the bytes."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
