from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trustlens.schemas import BUSINESSES, RESPONSES, REVIEWS, Feedback  # noqa: E402
from trustlens.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    ckpt = tmp_path_factory.mktemp("ckpt")
    wh = tmp_path_factory.mktemp("warehouse")
    session = build_session(
        "local[4]",
        4,
        app="trustlens-tests",
        extra={"spark.checkpoint.dir": str(ckpt), "spark.sql.warehouse.dir": str(wh)},
    )
    yield session
    session.stop()


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def feedback(spark, businesses, reviews, responses=()) -> Feedback:
    """Feedback tables from Python rows (tuples in schema column order)."""
    return Feedback(
        spark.createDataFrame(list(businesses), BUSINESSES),
        spark.createDataFrame(list(reviews), REVIEWS),
        spark.createDataFrame(list(responses), RESPONSES),
    )


def biz(i: int, industry: str = "Retail", location: str = "City", lat: float = 6.5, lon: float = 3.3):
    return (i, f"B{i}", industry, location, lat, lon)


def review(i: int, business: int, rating, created, sentiment=0.5):
    return (i, business, rating, "t", sentiment, ts(created) if isinstance(created, str) else created)


def reply(i: int, review_id: int, at: str = "2024-06-01 00:00:00"):
    return (i, review_id, "r", ts(at))


def rows_by(df, key: str) -> dict:
    return {r[key]: r.asDict() for r in df.collect()}
