from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from trustlens.llm import rule_ensemble as re_
from llm_fixtures import make_docs, shipped  # noqa: F401


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    got = re_.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in got)
    kept = [r["predicted"] for r in got if r["quality"] == 1]
    assert len(got) > 40 and right / len(got) > 0.95 and np.mean(kept) > 0.98


def test_column_equals_numpy(spark):
    """The compiled expression gives what the rules give on the same statistics."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    model = re_.train(docs, labels)
    assert model.rules and all(len(r) <= 2 * re_.DEPTH for _, r in model.rules)
    rows = re_.statistics(docs, "doc_id").withColumn("score", model.column()).collect()
    for r in rows[:100]:
        total = model.intercept + sum(
            w for w, rule in model.rules if all(r[n] <= t if s == "<=" else r[n] > t for n, s, t in rule)
        )
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-12


def test_lasso_keeps_few_rules_and_finds_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.4)).astype(float)
    model = re_.fit(x, y, np.arange(3000) % 5, ("a", "b", "c", "d"))
    total = np.full(len(x), model.intercept)
    for w, rule in model.rules:
        total += w * re_._holds(x, ("a", "b", "c", "d"), rule)
    assert ((total > 0) == (y > 0)).mean() > 0.98
    rules = re_.extract_rules(x, y, ("a", "b", "c", "d"))
    assert len(model.rules) < len(rules) / 2


def test_only_training_labels_are_read(spark, make_docs):
    """Turning every held-out label leaves the model as it is."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["good", "fine", "text"]) + ("###" if i % 3 == 0 else "") for _ in range(30))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    flipped = labels.withColumn("quality", F.when(re_.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    docs = make_docs(rows)
    assert re_.train(docs, labels) == re_.train(docs, flipped)
    got = re_.classify(docs, labels).collect()
    assert all((r["predicted"] == 1) == (r["doc_id"] % 3 != 0) for r in got)


@pytest.mark.parametrize("labels, score", [([], 1.0), ([(1, 1, 0)], 1.0), ([(1, 0, 0)], 0.0), ([(None, 0, 0), (2, None, 0)], 1.0)])
def test_without_two_classes(spark, make_docs, labels, score):
    docs = make_docs([(1, "some words"), (2, None), (None, ""), (1, "some words")], extra=["score", "words", "label"])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = re_.classify(docs, table).collect()
    assert len(got) == 4 and all(abs(r["score"] - score) < 1e-9 for r in got)
    kept = re_.reject(docs, table)
    assert kept.columns == docs.columns and kept.count() == (4 if score else 0)


def test_empty_table(spark, make_docs):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    assert re_.classify(make_docs([]), labels).count() == 0


def test_statistics_of_odd_texts(make_docs):
    got = re_.statistics(make_docs([(1, None), (2, ""), (3, "\n \n"), (4, "A A a\n\nA A a"), (5, "é## !")]), "doc_id").collect()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i][c] == 0.0 for i in (1, 2) for c in re_.STATISTICS)
    assert by[3]["n_words"] == 0 and by[4]["repeated_lines"] == 0.5 and by[4]["stutter"] == 2 / 6
    assert by[5]["symbols"] == 1.0 and by[5]["bare_words"] == 0.5 and by[5]["other"] == 1 / 5
