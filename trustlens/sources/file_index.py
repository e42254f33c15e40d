"""Range-clustered Parquet folders with an index of their files.

``write_clustered`` deals rows to files by ranges of the given columns, so that the rows of one key lie in
few neighbouring files, however the input came. ``index_files`` describes every file in one row:
row count, least and greatest value of some columns, and a Bloom filter of one key column, sized by
the file's own number of distinct keys. A point look-up asks the index for the files that may hold a
key and opens only those; the rest of the folder is not even listed.

The Bloom filter is a map from 64-bit word number to word, made by two grouped aggregates; words
without a bit are not stored. At ``BITS_PER_KEY`` bits and ``HASHES`` hashes a key that a file does not
hold passes with a chance of about 0.0024.

**Cases.** Null keys enter neither the ranges nor the filter; their number is a column of the
index, and a look-up may ask for files that hold some. A file without keys has null ranges
and an empty filter; an empty folder has an empty index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustlens.plans.sizing import spread

BITS_PER_KEY = 16
HASHES = 4


def write_clustered(df: DataFrame, path: str, by: Sequence[str], ranges: int, rows_per_file: int = 0) -> None:
    """``df`` cut into about ``ranges`` ranges of the columns ``by`` and sorted by them: a task and a Parquet file each, or
    files of at most ``rows_per_file`` rows, one after the other."""
    keys = [F.col(c).asc_nulls_first() for c in by]
    clustered = df.repartitionByRange(max(1, ranges), *keys).sortWithinPartitions(*keys)
    clustered.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def _position(key: Column, seed: int, bits: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), bits)


def _bit(position: Column) -> Column:
    """The word with the one bit of a position."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), position.bitwiseAND(F.lit(63)).cast("int"))


def _filters(rows: DataFrame, key: str) -> DataFrame:
    """(file, bits, bloom) of each file of ``rows`` (columns file and ``key``) that has keys."""
    keys = rows.where(F.col(key).isNotNull()).select("file", F.col(key).alias("key")).distinct()
    n_keys = F.count(F.lit(1)).over(Window.partitionBy("file"))
    sized = keys.withColumn("bits", F.pow(2, F.ceil(F.log2(n_keys * BITS_PER_KEY))).cast("long"))
    at = F.explode(F.array(*[_position(F.col("key"), seed, F.col("bits")) for seed in range(HASHES)]))
    words = sized.select("file", "bits", at.alias("at")).groupBy("file", "bits", F.shiftright("at", 6).alias("word"))
    words = words.agg(F.bit_or(_bit(F.col("at"))).alias("set_bits"))
    return words.groupBy("file", "bits").agg(F.map_from_entries(F.collect_list(F.struct("word", "set_bits"))).alias("bloom"))


def index_files(df: DataFrame, key: str, ranges: Sequence[str]) -> DataFrame:
    """One row per file that ``df`` (a read of Parquet files) scans: file (its path), n_rows, null_keys
    (rows whose ``key`` is null), min_c and max_c of every column in ``ranges``, bits and bloom of ``key``."""
    columns = dict.fromkeys([key, *ranges])
    rows = df.select(F.col("_metadata.file_path").alias("file"), *columns)
    bounds = [f(c).alias(f"{name}_{c}") for c in ranges for name, f in (("min", F.min), ("max", F.max))]
    one = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(key).isNull()).alias("null_keys"), *bounds)
    found = spread(_filters(rows, key).withColumnRenamed("file", "of_file"))
    return one.join(found, one["file"] == found["of_file"], "left").drop("of_file")


def may_hold(key: Column) -> Column:
    """Whether the index row's file may hold ``key``, by its Bloom filter."""
    hit = F.lit(True)
    for seed in range(HASHES):
        at = _position(key.cast("long"), seed, F.col("bits"))
        word = F.try_element_at(F.col("bloom"), F.shiftright(at, 6))
        hit = hit & (F.coalesce(word, F.lit(0)).bitwiseAND(_bit(at)) != 0)
    return F.coalesce(hit, F.lit(False))


def files_of(index: DataFrame, key: str, values: Sequence[int], others: Column | None = None) -> list[str]:
    """Paths of the files that may hold one of the ``values`` of ``key`` (or for which ``others`` holds)."""
    wanted = F.lit(False) if others is None else F.coalesce(others, F.lit(False))
    for value in values:
        v = F.lit(value).cast("long")
        inside = (F.col(f"min_{key}") <= v) & (F.col(f"max_{key}") >= v)
        wanted = wanted | (F.coalesce(inside, F.lit(False)) & may_hold(v))
    return sorted(r["file"] for r in index.where(wanted).select("file").collect())


def between(column: str, low, high) -> Column:
    """Whether the index row's file has a range of ``column`` that meets [low, high] (no file if these are null)."""
    return (F.col(f"max_{column}") >= F.lit(low)) & (F.col(f"min_{column}") <= F.lit(high))


def paths_where(index: DataFrame, wanted: Column) -> list[str]:
    """Paths of the files for which ``wanted`` holds; a folder's path for all its files, so that neither their names go
    through the driver nor Spark lists them one by one."""
    wanted = F.coalesce(wanted, F.lit(False))
    folders = index.groupBy(F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("folder")).agg(
        F.bool_and(wanted).alias("whole"), F.collect_list(F.when(wanted, F.col("file"))).alias("files")
    )
    paths = folders.select(F.explode(F.when(F.col("whole"), F.array("folder")).otherwise(F.col("files"))).alias("path"))
    return sorted(r["path"] for r in paths.collect())


def read_files(spark: SparkSession, schema, paths: Sequence[str]) -> DataFrame:
    """A scan of just the given files (or folders); no rows without any."""
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
