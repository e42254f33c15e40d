from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF_MID
from trustlens.llm import queries
from trustlens.llm import target_resampling as tr
from llm_fixtures import make_docs, shipped  # noqa: F401

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, orders=1):
    words = WORDS.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, least=20, buckets=10_000, orders=1):
    """(doc_id, n_features, weight, score, rank) by the plain definition."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in runs(text, orders)[1]:
                counts[bucket(f)] += 1
    big, small = float(sum(s) + buckets), float(sum(t) + buckets)
    gain = [math.floor(1000 * math.log((b + 1) * big / ((a + 1) * small))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        words, found = runs(text, orders)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(found), weight, score, len(words)))
    key = lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2])
    pool = sorted((r for r in rows if r[4] >= least), key=key)
    k = percent * len(pool) // 100
    drawn = [(*r[:4], i + 1) for i, r in enumerate(pool[:k])]
    rest = [(*r[:4], None) for r in pool[k:]] + [(*r[:4], None) for r in rows if r[4] < least]
    return sorted(drawn + rest, key=str)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF_MID}/benchmark.parquet").select("text").collect()]
    assert plain(queries.queries()["op12_target_resampling"](spark, SF_MID)) == brute(docs, target)


def made(n, seed):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "ÄRGER", "naïve", "日本語", "x1", "O'Neil", "a--b", "ЖУК", "z" * 70]
    return [(rng.randrange(n), " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("orders", [1, 3])
@pytest.mark.parametrize("percent", [0, 37, 100])
def test_odd_rows(spark, make_docs, orders, percent):
    rows = made(120, 3) + [(500, None), (501, ""), (502, " -- "), (None, "alpha " * 25), (None, "alpha " * 25), (None, None)]
    rows += [(600, "beta " * 30)] * 60 + [(600, "beta " * 31)] * 3  # one id and score many times over
    docs = make_docs(rows, extra=["score", "weight", "place", "rank", "part", "n"])
    texts = ["Alpha beta", None, "", "日本語 alpha x1"]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    got = tr.resample(docs.repartition(5), target, percent=percent, orders=orders, buckets=97)
    assert plain(got) == brute(rows, texts, percent=percent, orders=orders, buckets=97)


def test_empty_tables(spark, make_docs):
    target = spark.createDataFrame([], "item_id long, text string")
    assert tr.resample(make_docs([]), target).collect() == []
    rows = made(30, 4)
    assert plain(tr.resample(make_docs(rows), target)) == brute(rows, [])


def test_pieces_cut_only_between_words(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab9 é.-") for _ in range(rng.randrange(200))) for _ in range(40)] + ["k" * 300, "", None, "q" * 5]
    for limit in (1, 2, 7, 64, 10_000):
        monkeypatch.setattr(tr.pieces, "__defaults__", (limit,))
        for orders in (1, 2):
            got = [(int(r), int(b)) for rows, bs, _ in tr.features(pa.array(texts), 1009, orders) for r, b in zip(rows, bs)]
            want = [(i, zlib.crc32(f.encode()) % 1009) for i, t in enumerate(texts) for f in runs(t, orders)[1]]
            assert sorted(got) == sorted(want)


def test_crc32_of_spans():
    rng = np.random.default_rng(6)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4800, 300)
    ends = starts + np.concatenate([np.arange(100), rng.integers(0, 60, 200)])
    want = [zlib.crc32(data[s:e].tobytes()) for s, e in zip(starts, ends)]
    assert tr.crc32_spans(data, starts, ends).tolist() == want
    assert len(tr.crc32_spans(data, starts[:0], ends[:0])) == 0


def test_quickselect_on_a_hot_score(spark):
    """Any k, with a third of all rows alike in everything but their place."""
    rows = [(i % 7 if i % 3 else 5, 30, 4, 0, 10 if i % 3 == 0 else i % 11, i) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long, place long").cache()
    keys = sorted((-r[4], False, r[0], r[2], r[3], r[5]) for r in rows)
    for k in (1, 2, 199, 200, 201, 400, 600):
        assert tuple(tr.kth_key(table, 600, k)) == keys[k - 1]


def test_very_long_text_and_word(spark, make_docs):
    rows = [(1, "word " * 400_000), (2, "w" * 3_000_000), (3, "some words here " * 10)]
    target = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert plain(tr.resample(make_docs(rows), target, percent=50)) == brute(rows, ["word"], percent=50)
