"""Typed schemas of the three input tables and the container that carries them.

Keys are BIGINT rather than INT: at 100 TB the review and reply tables hold far more
than 2**31 rows, so 32-bit ids would overflow. Primary keys are declared nullable:
Spark does not enforce keys, a false NOT NULL would let the optimizer drop NULL
checks, and the key check job (O19) reports NULL and duplicate keys instead. Timestamps have no zone
(``timestamp_ntz``), like the source data; nothing here depends on the session zone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

BUSINESSES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("industry", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)

REVIEWS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("business_id", T.LongType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("sentiment_score", T.DoubleType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

RESPONSES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("review_id", T.LongType()),
        T.StructField("response_text", T.StringType()),
        T.StructField("responded_at", T.TimestampNTZType()),
    ]
)

SCHEMAS = {"businesses": BUSINESSES, "reviews": REVIEWS, "responses": RESPONSES}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order, cast to its types (no rows dropped)."""
    return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


@dataclass(frozen=True)
class Feedback:
    """The three input tables. Operators only read the columns they need, so
    Catalyst prunes the rest at the scan."""

    businesses: DataFrame
    reviews: DataFrame
    responses: DataFrame

    def conformed(self) -> "Feedback":
        return Feedback(
            conform(self.businesses, BUSINESSES),
            conform(self.reviews, REVIEWS),
            conform(self.responses, RESPONSES),
        )
