from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from trustlens.llm import winnowing
from llm_fixtures import make_docs, shipped  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _words(text):
    return WORD.findall((text or "").translate(LOWER))


def _brute(docs, items):
    windows = []
    for item_id, text in items:
        w = _words(text)
        size = min(10, len(w))
        windows += [(item_id, tuple(w[i : i + size])) for i in range(len(w) - size + 1)] if w else []
    out = []
    for doc_id, text in docs:
        w, hit, found = _words(text), set(), set()
        for item_id, window in windows:
            n = len(window)
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == window:
                    hit |= set(range(i, i + n))
                    found |= {str(item_id)} if item_id is not None else set()
        out.append((doc_id, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def _found(docs, bench):
    rows = winnowing.contamination(docs, bench).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in rows), key=repr)


def _bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("clash"))


@pytest.mark.parametrize("vocabulary", [2, 6, 400])
def test_equals_brute_force(spark, make_docs, vocabulary):
    """Small vocabularies give equal hashes within a window (ties) and overlapping hits."""
    rng = random.Random(vocabulary)

    def text(n):
        return rng.choice([" ", ", ", "-"]).join(f"W{rng.randrange(vocabulary)}" for _ in range(n))

    items = [(i, text(rng.randrange(1, 30))) for i in range(12)] + [(50, ""), (51, None), (52, "--"), (None, text(15))]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(30)]
    for i in range(30, 50):
        w = _words(rng.choice(items[:12])[1])
        a = rng.randrange(max(1, len(w) - 8))
        docs.append((i, text(rng.randrange(12)) + " " + " ".join(w[a : a + rng.randrange(5, 25)]) + "\n" + text(5)))
    docs += [(60, None), (61, ""), (None, items[-1][1]), (docs[35][0], docs[35][1])]
    assert _found(make_docs(docs, extra=["hashes", "grams", "item_id"]), _bench(spark, items)) == _brute(docs, items)


def test_every_span_of_ten_words_is_found(spark, make_docs):
    words = [f"q{i}" for i in range(30)]
    docs = [(i, "x y " + " ".join(words[i : i + 10]) + " z") for i in range(21)] + [(99, " ".join(words[3:12]))]
    got = _found(make_docs(docs), _bench(spark, [(1, " ".join(words))]))
    assert [r[2] for r in sorted(got)] == [10] * 21 + [0]


def test_shuffle_join_gives_the_same(spark, make_docs, monkeypatch):
    words = [f"q{i}" for i in range(40)]
    docs = make_docs([(1, " ".join(words)), (2, " ".join(words[5:17]) + " and more"), (3, "clean text")])
    bench = _bench(spark, [(7, " ".join(words[2:25])), (8, "clean")])
    want = _found(docs, bench)
    monkeypatch.setattr(winnowing, "broadcast_if_small", lambda df: df)
    assert _found(docs, bench) == want and want[0][3] == ["7"]


def test_empty_tables(spark, make_docs):
    docs, none = make_docs([(1, "a b c d e f g h i j k")]), spark.createDataFrame([], "item_id long, text string")
    assert _found(docs, none) == [(1, 11, 0, [], False)]
    assert _found(make_docs([]), _bench(spark, [(1, "a b")])) == []


def test_a_very_long_text(spark, make_docs):
    words = [f"t{i % 9973}" for i in range(60_000)]
    words[59_980:59_995] = [f"item{i}" for i in range(15)]
    docs = make_docs([(1, " ".join(words))])
    assert _found(docs, _bench(spark, [(3, " ".join(f"item{i}" for i in range(15)))])) == [(1, 60_000, 15, ["3"], True)]
