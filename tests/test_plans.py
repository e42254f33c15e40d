"""Plan properties: no cartesian products, windows only over aggregated rows, filter
pushdown to the scans, and the co-located join of the bucketed layout."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tools.inspect_plan import first_below, node_names, physical_plan, scans
from trustlens import operators as O
from trustlens.plans import contract as entry
from trustlens.plans.refresh import append_bucketed, save_bucketed
from trustlens.schemas import Feedback
from trustlens.session import CLUSTER_CONF
from trustlens.sources import load_profile, read_tables, write_tables


@pytest.fixture()
def static_plans(spark):
    """Plan checks on the static plan (AQE off, no broadcast) as a large input would get it."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cartesian_products(static_plans, name):
    df = entry.queries()[name](static_plans, SF_SMALL)
    names = node_names(df)
    assert "CartesianProduct" not in names and "BroadcastNestedLoopJoin" not in names


@pytest.mark.parametrize("name", ["daily_stats", "geo_insight", "business_trends"])
def test_windows_run_over_aggregates(static_plans, name):
    """Every window's input is an aggregate (daily rows or a histogram), not data rows."""
    df = entry.queries()[name](static_plans, SF_SMALL)
    for node in physical_plan(df).walk():
        if node.name == "Window":
            assert first_below(node, ("HashAggregate", "SortAggregate", "ObjectHashAggregate", "Scan")) in (
                "HashAggregate",
                "SortAggregate",
                "ObjectHashAggregate",
            )


def test_business_filter_reaches_review_scan(static_plans):
    fb, as_of = load_profile(static_plans, SF_SMALL, "orders")
    df = O.trust_score(fb, as_of).filter(F.col("business_id") == 7)
    orders_scan = [s for s in scans(df) if "orders" in s]
    assert orders_scan and all("o_custkey" in s and "EqualTo" in s for s in orders_scan)


def test_scans_read_only_needed_columns(static_plans):
    fb, as_of = load_profile(static_plans, SF_SMALL, "orders")
    for s in scans(O.trust_score(fb, as_of)):
        assert "o_totalprice" not in s and "l_extendedprice" not in s and "c_acctbal" not in s


def test_bucketed_layout_joins_without_shuffle(static_plans):
    fb, as_of = load_profile(static_plans, SF_SMALL, "orders")
    save_bucketed(fb, static_plans, "bk_", 4)
    static_plans.conf.set("spark.sql.shuffle.partitions", "4")
    df = O.trust_score(read_tables(static_plans, prefix="bk_"), as_of)
    # only the per-business partial aggregates are shuffled
    assert node_names(df).count("Exchange") == 1
    assert df.count() == O.trust_score(fb, as_of).count()


REVIEW_SOURCES = ("orders.parquet", "events.parquet")


def _raw_review_rows(node) -> bool:
    """Whether review rows reach ``node`` from a scan without passing an aggregate."""
    if "Aggregate" in node.name:
        return False
    if node.name.startswith("Scan"):
        return any(src in node.text for src in REVIEW_SOURCES)
    return any(_raw_review_rows(c) for c in node.children)


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if not k.endswith("_events")))
def test_business_key_shuffles_carry_aggregates_only(static_plans, name):
    """A business may hold a third of all reviews: review rows keyed by business are
    only ever shuffled after a (partial) aggregate, one row per business and map task."""
    df = entry.queries()[name](static_plans, SF_SMALL)
    for node in physical_plan(df).walk():
        if node.name == "Exchange" and "hashpartitioning(business_id" in node.text:
            assert not _raw_review_rows(node), (name, node.text)


def test_raw_review_shuffle_is_detected(static_plans):
    fb, _ = load_profile(static_plans, SF_SMALL, "orders")
    bad = fb.reviews.repartition("business_id").groupBy("business_id").count()
    exchanges = [n for n in physical_plan(bad).walk() if n.name == "Exchange"]
    assert any(_raw_review_rows(n) for n in exchanges)


def _reply_scans(tree):
    return [n for n in tree.walk() if n.name.startswith("Scan") and "lineitem" in n.text]


def _review_scans(tree):
    return [n for n in tree.walk() if n.name.startswith("Scan") and "orders" in n.text]


@pytest.mark.parametrize("part", ["markers", "extent", "keys"])
def test_geo_parts_without_replies(static_plans, part):
    """Markers, extent and ranking keys use no reply column: one review scan, no reply scan."""
    fb, _ = load_profile(static_plans, SF_SMALL, "orders")
    geo = O.geo_sentiment(fb)
    df = {
        "markers": lambda: O.geo_markers(geo),
        "extent": lambda: O.geo_extent(O.geo_markers(geo)),
        "keys": lambda: O.ranking_keys(geo, "review_count", "location_id", "net_sentiment_score"),
    }[part]()
    tree = physical_plan(df)
    assert not _reply_scans(tree) and len(_review_scans(tree)) == 1
    assert _reply_scans(physical_plan(geo))


def test_trust_band_starts_no_job(static_plans):
    fb, as_of = load_profile(static_plans, SF_SMALL, "orders")
    sc = static_plans.sparkContext
    sc.setJobGroup("trust-band", "building the query")
    entry.SPARK_BUILDS["trust_band"](fb, as_of)
    jobs = sc.statusTracker().getJobIdsForGroup("trust-band")
    sc.setJobGroup("", "")
    assert list(jobs) == []


def test_comparison_joins_on_the_industry_only(static_plans):
    fb, as_of = load_profile(static_plans, SF_SMALL, "orders")
    twice = Feedback(fb.businesses.unionByName(fb.businesses.filter("id = 7")), fb.reviews, fb.responses)
    df = entry.SPARK_BUILDS["benchmark_comparison"](twice, as_of)
    joins = [n for n in physical_plan(df).walk() if n.name.endswith("Join")]
    assert [("business_id" in n.text) for n in joins] == [False]
    assert df.filter("business_id = 7").count() == 4


def test_lookup_shuffles_only_its_replies(spark):
    """Replies carry no business id: the look-up semi-joins them to the business's stored
    review ids before they are grouped, whatever the size of the tables."""
    from trustlens import api

    fb, as_of = load_profile(spark, SF_SMALL, "orders")
    only = api._only(fb, 7, fb.reviews)
    wanted = fb.responses.join(fb.reviews.filter("business_id = 7"), F.col("review_id") == fb.reviews["id"], "left_semi")
    assert only.responses.count() == wanted.count() < fb.responses.count()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        plan = api.trust_score(fb, 7, as_of)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_recent_replies_are_pruned_beyond_the_creation_threshold(spark):
    """O8 joins all replies with the reviews of 60 days. With the cluster settings Spark builds
    a bloom filter of those reviews though the review table lies above the default
    creation threshold (lowered here below this table's size)."""
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    keys = [k for k in CLUSTER_CONF if k.startswith(prefix)]
    assert f"{prefix}creationSideThreshold" in keys
    fb, as_of = load_profile(spark, SF_SMALL, "orders")
    old = {k: spark.conf.get(k) for k in [*keys, f"{prefix}applicationSideScanSizeThreshold"]}

    def plan() -> str:
        return O.performance_deltas(fb, as_of)._jdf.queryExecution().optimizedPlan().toString()

    try:
        spark.conf.set(f"{prefix}applicationSideScanSizeThreshold", "1")
        spark.conf.set(f"{prefix}creationSideThreshold", "1000")
        assert "might_contain" not in plan()
        for k in keys:
            spark.conf.set(k, CLUSTER_CONF[k])
        spark.conf.set(f"{prefix}applicationSideScanSizeThreshold", "1")
        assert "might_contain" in plan()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _files(spark, table: str) -> int:
    return len(spark.table(table).inputFiles())


def test_file_count_does_not_follow_the_input_tasks(static_plans, tmp_path):
    fb, _ = load_profile(static_plans, SF_SMALL, "orders")
    many = Feedback(fb.businesses, fb.reviews.repartition(16), fb.responses.repartition(16))
    for prefix, data in (("f1_", fb), ("f2_", many)):
        save_bucketed(data, static_plans, prefix, 4)
    assert _files(static_plans, "f1_reviews") == _files(static_plans, "f2_reviews") == 4
    save_bucketed(many, static_plans, "f3_", reviews_by_month=True)  # bucket count from the volume
    months = static_plans.table("f3_reviews").select("created_month").distinct().count()
    assert _files(static_plans, "f3_reviews") == months
    static_plans.conf.set("spark.sql.adaptive.enabled", "true")
    write_tables(many, str(tmp_path / "m"), reviews_by_month=True)
    stored = read_tables(static_plans, str(tmp_path / "m"), reviews_by_month=True)
    assert len(stored.reviews.inputFiles()) <= 2 * months


def test_append_into_the_bucketed_layout(static_plans):
    fb, as_of = load_profile(static_plans, SF_SMALL, "orders")
    even = F.col("id") % 2 == 0
    save_bucketed(
        Feedback(fb.businesses, fb.reviews.filter(even), fb.responses.filter(even)), static_plans, "ap_", 4, reviews_by_month=True
    )
    rest = Feedback(fb.businesses.limit(0), fb.reviews.filter(~even), fb.responses.filter(~even))
    append_bucketed(rest, static_plans, "ap_")
    static_plans.conf.set("spark.sql.shuffle.partitions", "4")
    stored = read_tables(static_plans, prefix="ap_")
    a, b = entry.rounded(O.trust_score(stored, as_of)), entry.rounded(O.trust_score(fb, as_of))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert node_names(O.trust_score(stored, as_of)).count("Exchange") == 1


def test_bucketed_month_partitioned_layout(static_plans):
    """Buckets within month partitions: O8 prunes months and its reply join needs no
    exchange on either side."""
    from trustlens.plans.contract import rounded

    fb, as_of = load_profile(static_plans, SF_SMALL, "orders")
    save_bucketed(fb, static_plans, "bm_", 4, reviews_by_month=True)
    static_plans.conf.set("spark.sql.shuffle.partitions", "4")
    stored = read_tables(static_plans, prefix="bm_")
    assert "created_month" in stored.reviews.columns
    df = O.performance_deltas(stored, as_of)
    tree = physical_plan(df)
    review_scans = [n for n in tree.walk() if n.name.startswith("Scan") and "bm_reviews" in n.text]
    assert review_scans and all("created_month" in n.meta.get("PartitionFilters", "") for n in review_scans)
    # only the per-business partial aggregates are shuffled
    assert [n.name for n in tree.walk()].count("Exchange") == 1
    a, b = rounded(df), rounded(O.performance_deltas(fb, as_of))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
