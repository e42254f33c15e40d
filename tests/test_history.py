"""The trust score at many dates equals O2 at each of them."""

from __future__ import annotations

from datetime import date, timedelta

from conftest import feedback
from test_store import made, rows
from pyspark.sql import functions as F
from tools.inspect_plan import physical_plan
from trustlens import operators as O
from trustlens.sources.store import stack

DATES = [date(2024, 6, 30) - timedelta(days=d) for d in (0, 1, 45, 700, 1600, -300)]


def _fb(spark):
    batches = made(11, n_batches=2)
    return feedback(spark, *[[r for b in batches for r in b[k]] for k in range(3)])


def test_history_equals_score_at_each_date(spark):
    fb = _fb(spark)
    want = stack([O.trust_score(fb, str(d)).withColumn("as_of", F.lit(d)) for d in DATES])
    assert rows(O.trust_history(fb, DATES)) == rows(want)


def test_no_dates_no_rows_and_unrated(spark):
    fb = _fb(spark)
    assert O.trust_history(fb, []).count() == 0
    assert O.trust_history(feedback(spark, [], [], []), DATES).count() == 0
    unrated = feedback(spark, [(1, "n", "i", "l", 0.0, 0.0)], [(1, 1, None, "t", None, None), (2, 1, None, "t", None, None)])
    want = stack([O.trust_score(unrated, str(d)).withColumn("as_of", F.lit(d)) for d in DATES[:2]])
    assert rows(O.trust_history(unrated, DATES[:2])) == rows(want)


def test_reads_once_for_any_number_of_dates(spark):
    from conftest import SF_SMALL
    from trustlens.sources.fixtures import load_profile

    fb, _ = load_profile(spark, SF_SMALL, "orders")
    plans = [physical_plan(O.trust_history(fb, [date(1997, 1, 1) + timedelta(days=30 * i) for i in range(n)])) for n in (1, 24)]
    scans = [sum(n.name.startswith("Scan") for n in p.walk()) for p in plans]
    # reviews with their ratings, reviews with their replies, replies, businesses (and their locations)
    assert scans[0] == scans[1] <= 5
