"""The versioned store: layout, file index, ledger, versions, incremental refresh."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import biz, feedback, reply, review
from trustlens import api
from trustlens import operators as O
from trustlens.plans import incremental
from trustlens.schemas import Feedback
from trustlens.sources import file_index
from trustlens.sources.store import FeedbackStore

AS_OF = "2024-06-30 12:00:00"


@pytest.fixture
def store(spark, tmp_path):
    return FeedbackStore.create(spark, str(tmp_path / "store"), rows_per_file=100)


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=repr)


def made(seed, n_batches=3, n=100, businesses=6):
    """Batches of rows with replies to earlier, later, unknown and no reviews, and a business of a third of the reviews."""
    rng = random.Random(seed)
    ids = list(range(1, n_batches * n + 1))
    batches, reply_id = [], 0
    for b in range(n_batches):
        own = ids[b * n : (b + 1) * n]
        reviews = []
        for i in own:
            day = datetime(2024, 6, 1) + timedelta(days=rng.randrange(-900, 40), hours=rng.randrange(24))
            business = 1 if rng.random() < 0.33 else rng.choice([*range(1, businesses + 1), None, 99])
            key = None if rng.random() < 0.03 else i
            reviews.append((key, business, rng.choice([None, 1, 2, 3, 4, 5]), "t", rng.choice([None, -0.5, 0.25]), rng.choice([day, day, day, None])))
        replies = []
        for _ in range(n):
            reply_id += 1
            of = rng.choice([rng.choice(own), rng.choice(ids), rng.choice(ids[: (b + 1) * n]), None, 10_000, own[0]])
            replies.append((None if rng.random() < 0.03 else reply_id, of, "r", datetime(2024, 6, 1)))
        people = [biz(i, industry=f"I{i % 2}") for i in range(1, businesses + 1) if i % n_batches == b]
        batches.append((people, reviews, replies))
    return batches


def union(spark, batches):
    return feedback(spark, *[[r for b in batches for r in b[k]] for k in range(3)])


@pytest.mark.parametrize("seed", [1])
def test_incremental_refresh_equals_full(spark, store, seed):
    batches = made(seed)
    for i, batch in enumerate(batches):
        store.append(feedback(spark, *batch), f"b{i}")
        if i == 1:
            continue  # the next refresh takes two batches at once
        version = incremental.refresh(store, AS_OF)
        fb = union(spark, batches[: i + 1])
        assert rows(store.derived("model", "daily_stats", version)) == rows(O.daily_stats(fb))
        trust = O.trust_score(fb, AS_OF)
        assert rows(store.derived("model", "trust_score")) == rows(trust)
        assert rows(store.derived("model", "industry_benchmarks")) == rows(O.industry_benchmarks(fb, AS_OF))
    later = "2025-01-01 00:00:00"
    incremental.refresh(store, later)  # no new batch: from the states alone
    assert rows(store.derived("model", "trust_score")) == rows(O.trust_score(fb, later))


def test_refresh_reads_only_new_rows(spark, store):
    """The sums of an append scan its own files; of stored replies only files that its replies point into."""
    first = [(i, 1 + i % 3, 4, "t", 0.1, datetime(2024, 1, 1)) for i in range(400)]
    store.append(feedback(spark, [biz(1), biz(2), biz(3)], first, [(i, i, "r", None) for i in range(400)]), "first")
    incremental.refresh(store, AS_OF)
    second = [(1000 + i, 1, 2, "t", 0.1, datetime(2024, 2, 1)) for i in range(50)]
    store.append(feedback(spark, [], second, [(1000 + i, 1000 + i, "r", None) for i in range(30)]), "second")
    old, new = store.batches()
    days, replies = incremental.deltas(store, [new], [old])
    assert days.inputFiles() and all(new["folder"] in f for f in [*days.inputFiles(), *replies.inputFiles()])
    store.append(feedback(spark, [], [], [(2000, 7, "r", None)]), "third")
    late = store.batches()[-1]
    _, replies = incremental.deltas(store, [late], [old, new])
    again = [f for f in replies.inputFiles() if late["folder"] not in f]
    assert 0 < len(again) < 10 and all("/responses/" in f for f in again)
    assert replies.collect() == [(2, 1, 1)]


def test_the_same_batch_twice(spark, store):
    batch, other = made(3, n_batches=2)
    version = store.append(feedback(spark, *batch), "monday")
    want = rows(store.read().reviews)
    assert store.append(feedback(spark, *batch), "monday") == version  # known to the ledger
    keyed = [[r for r in t if r[0] is not None] for t in batch]
    store.append(feedback(spark, *keyed), "monday again")  # every key is stored already
    assert rows(store.read().reviews) == want
    mixed = [[*a, *b] for a, b in zip(keyed, other)]
    store.append(feedback(spark, *mixed), "tuesday")  # only the new rows come in
    both = union(spark, [batch, other])
    got = store.read()
    assert rows(got.reviews) == rows(both.reviews) and rows(got.responses) == rows(both.responses)
    assert rows(got.businesses) == rows(both.businesses)
    incremental.refresh(store, AS_OF)
    assert rows(store.derived("model", "trust_score")) == rows(O.trust_score(both, AS_OF))


def test_readers_stay_at_their_version(spark, store):
    batches = made(4, n_batches=3)
    v1 = store.append(feedback(spark, *batches[0]), "b0")
    v2 = incremental.refresh(store, AS_OF)
    pinned = store.read(v2).reviews
    want, model = rows(pinned), rows(store.derived("model", "trust_score", v2))
    store.append(feedback(spark, *batches[1]), "b1")
    store.replace(feedback(spark, *batches[2]), "fresh start")
    incremental.refresh(store, AS_OF)
    assert rows(pinned) == want == rows(store.read(v1).reviews)
    assert rows(store.derived("model", "trust_score", v2)) == model
    only = feedback(spark, *batches[2])
    assert rows(store.read().reviews) == rows(only.reviews)
    assert rows(store.derived("model", "daily_stats")) == rows(O.daily_stats(only))
    with pytest.raises(LookupError):
        store.derived("model", "trust_score", v1)


@pytest.mark.parametrize("step", ["score_stats", "commit"])
def test_a_failed_refresh_changes_nothing(spark, store, monkeypatch, step):
    batches = made(5, n_batches=2, n=40)
    store.append(feedback(spark, *batches[0]), "b0")
    version = incremental.refresh(store, AS_OF)
    before = {m: rows(store.derived("model", m)) for m in incremental.MODELS}
    added = store.append(feedback(spark, *batches[1]), "b1")

    def fails(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(*((FeedbackStore, step) if step == "commit" else (incremental, step)), fails)
        with pytest.raises(RuntimeError):
            incremental.refresh(store, AS_OF)
    assert store.version() == added
    assert {m: rows(store.derived("model", m)) for m in incremental.MODELS} == before
    assert {m: rows(store.derived("model", m, version)) for m in incremental.MODELS} == before
    incremental.refresh(store, AS_OF)
    assert rows(store.derived("model", "trust_score")) == rows(O.trust_score(union(spark, batches), AS_OF))


def test_a_failed_append_is_not_seen(spark, store, monkeypatch):
    batch = made(6, n_batches=1, n=30)[0]
    with monkeypatch.context() as m:
        m.setattr(FeedbackStore, "commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.append(feedback(spark, *batch), "b0")
    assert store.batches() == [] and store.read().reviews.count() == 0
    store.append(feedback(spark, *batch), "b0")
    assert rows(store.read().reviews) == rows(feedback(spark, *batch).reviews)


def test_look_up_opens_few_of_a_thousand_files(spark, tmp_path):
    """Reviews in about 1,000 files: a look-up scans those that hold the business, a hot one too."""
    store = FeedbackStore.create(spark, str(tmp_path / "store"), rows_per_file=20)
    reviews = spark.range(20_000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(2000)) * 5).alias("business_id"),
        (F.col("id") % 5 + 1).cast("int").alias("rating"), F.lit("t").alias("text"), F.lit(0.5).alias("sentiment_score"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"),
    )
    people = spark.range(0, 10_000, 5).selectExpr("id", "'n' AS name", "'i' AS industry", "'l' AS location", "1D AS latitude", "1D AS longitude")
    replies = reviews.where("id % 40 = 0").selectExpr("id", "id AS review_id", "'r' AS response_text", "created_at AS responded_at")
    store.append(Feedback(people, reviews, replies), "all")
    index = store.index("reviews", store.batches())
    assert index.count() > 900
    for business in (0, 4555, 9995):
        found = store.of_business([business])
        assert 0 < len(found.reviews.inputFiles()) <= 3 and len(found.responses.inputFiles()) <= 6
        want = reviews.where(F.col("business_id") == business)
        assert rows(found.reviews) == rows(want)
        assert rows(found.responses) == rows(replies.join(want.select(F.col("id").alias("review_id")), "review_id", "left_semi"))
    hot = store.of_business([7]).reviews
    assert hot.count() == reviews.where("business_id = 7").count() and len(hot.inputFiles()) < 400
    # ids between those that are there: the range does not tell, the filter does
    assert sum(len(store.of_business([i]).reviews.inputFiles()) for i in range(1001, 1040) if i % 5) <= 2


def test_small_files_take_few_tasks(spark, store):
    """A task writes its range as several files, and a folder whose files are all wanted is read as a folder."""
    reviews = spark.range(4000).select(
        "id", F.pmod(F.xxhash64("id"), F.lit(900)).alias("business_id"), F.lit(3).alias("rating"), F.lit("t").alias("text"),
        F.lit(0.5).alias("sentiment_score"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"),
    )
    none = feedback(spark, [], [])
    store.append(Feedback(none.businesses, reviews, none.responses), "all")
    index = store.index("reviews", store.batches())
    files = [r["file"] for r in index.collect()]
    assert len(files) >= 40 and index.agg(F.max("n_rows")).first()[0] <= 100
    tasks = {f.rsplit("/", 1)[1].split("-")[1] for f in files}
    assert len(tasks) <= spark.sparkContext.defaultParallelism
    assert file_index.paths_where(index, file_index.between("id", 0, 4000)) == [files[0].rsplit("/", 1)[0]]
    assert file_index.paths_where(index, file_index.between("id", None, None)) == []
    some = file_index.paths_where(index, file_index.between("business_id", 5, 5))
    assert 0 < len(some) < 5 and set(some) <= set(files)


def test_look_ups_equal_filtered_operators(spark, store):
    batches = made(8)
    for i, batch in enumerate(batches):
        store.append(feedback(spark, *batch), f"b{i}")
    fb = union(spark, batches)
    bench = O.industry_benchmarks(fb, AS_OF)
    for i in (1, 99):
        theirs = store.of_business([i])
        assert rows(theirs.reviews) == rows(fb.reviews.where(F.col("business_id") == i))
        for look_up in (
            lambda x: api.business_overview(x, i, AS_OF, benchmarks=bench), lambda x: api.business_trends(x, i),
            lambda x: api.sentiment_distribution(x, i, AS_OF), lambda x: api.performance_deltas(x, i, AS_OF), lambda x: api.trust_score(x, i, AS_OF),
        ):
            assert rows(look_up(theirs)) == rows(look_up(fb))


def test_empty_store_and_batches(spark, store):
    assert store.version() == 0 and store.read().reviews.count() == 0 and store.of_business([1]).reviews.count() == 0
    incremental.refresh(store, AS_OF)
    assert store.derived("model", "trust_score").count() == 0
    store.append(feedback(spark, [], [], []), "nothing")
    store.append(feedback(spark, [biz(1)], [review(1, 1, 5, "2024-06-01")], [reply(1, 1)]), "one")
    incremental.refresh(store, AS_OF)
    got = store.derived("model", "trust_score").collect()
    assert [(r["business_id"], r["total_reviews"], r["response_rate"]) for r in got] == [(1, 1, 1.0)]
    with pytest.raises(Exception, match="(?i)exists"):
        FeedbackStore.create(spark, store.root)


def test_bloom_filter_never_misses(spark, tmp_path):
    keys = spark.range(3000).select(F.when(F.col("id") % 10 != 0, F.col("id") * 17 - 9000).alias("k"), (F.col("id") % 4).alias("v"))
    file_index.write_clustered(keys, str(tmp_path / "t"), ["v"], 4)
    index = file_index.index_files(spark.read.parquet(str(tmp_path / "t")), "k", ["k", "v"]).cache()
    assert index.agg(F.sum("n_rows"), F.sum("null_keys")).first() == (3000, 300)
    for i in (1, 2, 1501, 2999):
        assert len(file_index.files_of(index, "k", [i * 17 - 9000])) >= 1
    passed = [len(file_index.files_of(index, "k", [i * 17 - 9001])) for i in range(1, 60)]
    assert sum(passed) <= 4
    assert len(file_index.files_of(index, "k", [], F.col("null_keys") > 0)) == 2  # v = 0 and 2
