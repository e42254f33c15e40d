"""Map the driver's generated tables onto the three input tables.

Two profiles, each with its own fixed ``as_of``:

- ``orders``: customers (+ nation) are businesses, orders are reviews, returned line
  items are replies (0 to 7 per review, so the three reply-rate definitions differ).
- ``events``: events are reviews with sub-day timestamps, a subset of events are
  their own replies.

Ratings, sentiments and coordinates are derived from key arithmetic; sentiments are
multiples of a power of two, so their sums are exact in any order.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.schemas import Feedback


# Columns of the driver tables that the adapters read. Reading with an explicit schema
# skips Spark's schema-inference job over the file footers.
DRIVER_SCHEMAS = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderdate TIMESTAMP_NTZ, "
    "o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_linenumber INT, l_returnflag STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, props STRING",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _dbl(c) -> F.Column:
    return c.cast("double")


def _businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _read(spark, sf_dir, "customer")
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("c_custkey")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select(
        key.cast("bigint").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("industry"),
        F.col("n_name").alias("location"),
        (F.lit(6.4) + _dbl(key * 37 % 1024) / 4096).alias("latitude"),
        (F.lit(3.2) + _dbl(key * 101 % 1024) / 4096).alias("longitude"),
    )


def _orders_feedback(spark: SparkSession, sf_dir: str) -> Feedback:
    orders = _read(spark, sf_dir, "orders")
    rating = F.substring("o_orderpriority", 1, 1).cast("int")
    spread = _dbl(F.col("o_orderkey") * 7919 % 1024)
    sentiment = (
        F.when(rating >= 4, F.lit(0.3125) + spread / 2048)
        .when(rating <= 2, F.lit(-0.875) + spread * 3 / 4096)
        .otherwise(F.lit(-0.1875) + spread * 3 / 8192)
    )
    reviews = orders.select(
        F.col("o_orderkey").cast("bigint").alias("id"),
        F.col("o_custkey").cast("bigint").alias("business_id"),
        rating.alias("rating"),
        F.col("o_orderstatus").alias("text"),
        sentiment.alias("sentiment_score"),
        F.col("o_orderdate").alias("created_at"),
    )
    responses = (
        _read(spark, sf_dir, "lineitem")
        .filter(F.col("l_returnflag") == "R")
        .select(
            (F.col("l_orderkey") * 16 + F.col("l_linenumber")).cast("bigint").alias("id"),
            F.col("l_orderkey").cast("bigint").alias("review_id"),
            F.col("l_returnflag").alias("response_text"),
            F.col("l_shipdate").alias("responded_at"),
        )
    )
    return Feedback(_businesses(spark, sf_dir), reviews, responses)


def _events_feedback(spark: SparkSession, sf_dir: str) -> Feedback:
    events = _read(spark, sf_dir, "events")
    etype = F.col("event_type")
    rating = (
        F.when(etype == "error", 1)
        .when(etype == "view", 2)
        .when(etype == "click", 3)
        .when(etype == "signup", 4)
        .otherwise(5)
    )
    reviews = events.select(
        F.col("event_id").cast("bigint").alias("id"),
        F.col("user_id").cast("bigint").alias("business_id"),
        rating.alias("rating"),
        F.col("props").alias("text"),
        (F.lit(-1.0) + _dbl(F.col("event_id") * 7919 % 1024) / 512).alias("sentiment_score"),
        F.col("ts").alias("created_at"),
    )
    responses = events.filter(F.col("event_id") * 31 % 7 >= 3).select(
        F.col("event_id").cast("bigint").alias("id"),
        F.col("event_id").cast("bigint").alias("review_id"),
        etype.alias("response_text"),
        (F.col("ts") + F.make_dt_interval(hours=F.lit(5))).alias("responded_at"),
    )
    return Feedback(_businesses(spark, sf_dir), reviews, responses)


@dataclass(frozen=True)
class Profile:
    name: str
    as_of: str
    build: Callable[[SparkSession, str], Feedback]


# The as-of instant of each profile (chosen inside each profile's time span).
PROFILES = {
    "orders": Profile("orders", "2001-08-01 12:00:00", _orders_feedback),
    "events": Profile("events", "2024-02-15 06:00:00", _events_feedback),
}


def load_profile(spark: SparkSession, sf_dir: str, name: str = "orders") -> tuple[Feedback, str]:
    profile = PROFILES[name]
    return profile.build(spark, sf_dir), profile.as_of
