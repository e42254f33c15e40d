"""Materialisation and size-checked broadcast.

- ``materialize``: reliable checkpoint to the session's checkpoint folder. Used where
  one result feeds two branches of a plan (Spark would otherwise recompute it per
  branch when column pruning makes the branches differ) and where a later step needs
  the exact size of a small result.
- ``broadcast_if_small``: broadcast a join side only after measuring its bytes; above the
  limit the join stays a shuffle join (AQE still splits skewed partitions there).
- ``spread``: a join side that grows with the tables. Spark broadcasts what it estimates small from compressed
  bytes, and the rows, many times that, then go through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlens.session import ensure_checkpoint_dir

# Bytes of a join side that may be broadcast (as measured, below Spark's own 10 MB).
MAX_BROADCAST_BYTES = 8 << 20
# Rows of a side of a few fixed-width columns that may be broadcast.
MAX_BROADCAST_ROWS = 100_000


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the checkpoint folder and return the stored copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the values of ``df`` (16 per value for the row format, plus the length of
    what is not fixed width), from one aggregation."""
    size = F.lit(16 * max(1, len(df.columns)))
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) * 2
        elif isinstance(f.dataType, T.BinaryType):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
    return df.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0).cast("bigint"))).first()[0]


def broadcast_if_small(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its values measure at most ``max_bytes``, else as it
    is (a shuffle join). Only the join's physical form depends on this, never its
    rows. Measuring is one pass over ``df``: pass a materialised (small) DataFrame."""
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` as a side of a shuffle join, whatever its estimated size."""
    return df.hint("merge")
