"""Sources and sinks: typed scans, overwrite/append loads, emptiness, refresh, JSON."""

from __future__ import annotations

import json
import os

from conftest import SF_SMALL, biz, feedback, review
from trustlens import operators as O
from trustlens.plans.contract import rounded
from trustlens.plans.refresh import MODEL_ORDER, json_records, refresh_models, write_json
from trustlens.schemas import BUSINESSES, RESPONSES, REVIEWS
from trustlens.sources import append_tables, is_empty, load_profile, read_tables, write_tables


def test_write_read_append(spark, tmp_path):
    fb, _ = load_profile(spark, SF_SMALL, "orders")
    root = str(tmp_path / "tables")
    write_tables(fb, root)
    back = read_tables(spark, root)
    assert back.businesses.schema == BUSINESSES or [f.name for f in back.businesses.schema] == BUSINESSES.names
    assert [f.name for f in back.reviews.schema] == REVIEWS.names
    assert [f.name for f in back.responses.schema] == RESPONSES.names
    n = back.reviews.count()
    assert n == fb.reviews.count()
    append_tables(fb, root)
    assert read_tables(spark, root).reviews.count() == 2 * n
    write_tables(fb, root)  # overwrite replaces
    assert read_tables(spark, root).reviews.count() == n


def test_is_empty(spark):
    fb = feedback(spark, [biz(1)], [])
    assert is_empty(fb.reviews) and not is_empty(fb.businesses)


def test_refresh_models_in_order(spark, tmp_path):
    fb, as_of = load_profile(spark, SF_SMALL, "orders")
    out = refresh_models(fb, as_of, str(tmp_path / "models"))
    assert list(out) == list(MODEL_ORDER)
    assert out["trust_score"].count() == O.trust_score(fb, as_of).count()
    live = rounded(O.industry_benchmarks(fb, as_of))  # averages may add in another order
    assert rounded(out["industry_benchmarks"]).exceptAll(live).count() == 0


def test_json_records(spark, tmp_path):
    fb = feedback(spark, [biz(1)], [review(1, 1, 5, "2024-06-01 10:30:00"), review(2, 1, 4, "2024-06-02 00:00:00.250000")])
    trends = O.rating_trend_monthly(fb)
    assert [r["date"] for r in json_records(trends).collect()] == ["2024-06-01T00:00:00"]
    raw = json_records(fb.reviews.select("created_at")).collect()
    assert sorted(r[0] for r in raw) == ["2024-06-01T10:30:00", "2024-06-02T00:00:00.250000"]
    path = str(tmp_path / "json")
    write_json(O.daily_stats(fb), path)
    lines = [json.loads(x) for f in os.listdir(path) if f.endswith(".json") for x in open(os.path.join(path, f))]
    assert {d["date"] for d in lines} == {"2024-06-01", "2024-06-02"}


def test_register_views(spark):
    from trustlens.plans.refresh import register_views

    fb, as_of = load_profile(spark, SF_SMALL, "orders")
    register_views(fb, as_of, prefix="v_")
    n = spark.sql("SELECT COUNT(*) FROM v_industry_benchmarks").first()[0]
    assert n == O.industry_benchmarks(fb, as_of).count()
    assert spark.sql("SELECT MAX(cumulative_reviews) FROM v_daily_stats").first()[0] > 0


def test_month_partitioned_reviews_prune(spark, tmp_path):
    from pyspark.sql import functions as F

    from tools.inspect_plan import physical_plan

    fb, as_of = load_profile(spark, SF_SMALL, "orders")
    root = str(tmp_path / "by_month")
    write_tables(fb, root, reviews_by_month=True)
    stored = read_tables(spark, root, reviews_by_month=True)
    assert "created_month" in stored.reviews.columns
    for op in (O.sentiment_distribution, O.performance_deltas):
        a, b = rounded(op(stored, as_of)), rounded(op(fb, as_of))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
        scans = [n for n in physical_plan(op(stored, as_of)).walk() if n.name.startswith("Scan")]
        pruned = [n.meta.get("PartitionFilters", "") for n in scans if "created_month" in n.meta.get("PartitionFilters", "")]
        assert pruned, "the month predicate must reach the scan as a partition filter"
    assert stored.reviews.count() == fb.reviews.count()
    assert stored.reviews.filter(F.col("created_at").isNull()).count() == fb.reviews.filter(F.col("created_at").isNull()).count()
