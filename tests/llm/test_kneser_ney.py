from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trustlens.llm import kneser_ney as kn
from trustlens.llm.common import shared_folder
from llm_fixtures import make_docs, shipped  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _base(text):
    text = text or ""
    w = WORD.findall(text)
    triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


def _stream(text):
    return bytes([2]) * (kn.ORDER - 1) + " ".join(WORD.findall(text or "")).encode()


class Brute:
    """Modified Kneser-Ney in plain Python, one language."""

    def __init__(self, texts):
        top = Counter()
        for t in texts:
            s = _stream(t)
            top.update(s[i : i + kn.ORDER] for i in range(len(s) - kn.ORDER + 1) if WORD.search(t or ""))
        self.levels = {}
        counts = top
        for order in range(kn.ORDER, 0, -1):
            n = Counter(min(c, 5) for c in counts.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
            d = {}
            for i in (1, 2, 3):
                d[i] = 0.5 if not n[i] or y is None else max(0.0, i - (i + 1) * y * n[i + 1] / n[i])
            total, left = defaultdict(int), defaultdict(float)
            cut = {g: min(d[min(c, 3)], c) for g, c in counts.items()}
            for g, c in counts.items():
                total[g[:-1]] += c
                left[g[:-1]] += cut[g]
            self.levels[order] = {g: ((c - cut[g]) / total[g[:-1]]) for g, c in counts.items()}, {c: left[c] / total[c] for c in total}
            counts = Counter(g[1:] for g in counts)
        self.flat = 1 / (1 + len(self.levels[1][0]))

    def p(self, gram):
        if not gram:
            return self.flat
        share, back = self.levels[len(gram)]
        return share.get(gram, 0.0) + back.get(gram[:-1], 1.0) * self.p(gram[1:])

    def log_ppl(self, text):
        s = _stream(text)
        grams = [s[i : i + kn.ORDER] for i in range(len(s) - kn.ORDER + 1)] if WORD.search(text or "") else []
        return -sum(math.log(self.p(g)) for g in grams) / len(grams) if grams else None


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocabulary = ["the", "of", "träume", "und", "naïve", "running", "x1", "###", "stop.", "Ünder"]
    out = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    return out + ["a\nb\na\n\na b", "  \n", "", None, "one two three one two three", "tail \n", "\n lead", "é"]


def test_base_rules(texts):
    got = kn.base_rules(pa.array(texts, pa.string()))
    assert list(zip(*(got[c].tolist() for c in got))) == [_base(t) for t in texts]


def test_model_equals_brute_force_on_both_paths(spark, make_docs, texts):
    docs = make_docs([(i, t) for i, t in enumerate(texts)])
    folder = shared_folder(spark, "test-model")
    grams = kn.count_grams(docs)
    levels = kn.fit(grams, folder)
    model = Brute(texts)
    table = kn.model_probabilities(levels)
    for r in table.collect():
        assert math.isclose(r["log_p"], math.log(model.p(r["gram"].to_bytes(kn.ORDER, "big"))), rel_tol=1e-9)
    for i, limit in enumerate((kn.MAX_GRAMS, 0)):  # broadcast arrays, and the shuffle join
        scored = kn.score(docs, table, f"{folder}/{i}", limit)
        for r in scored.collect():
            want = model.log_ppl(texts[r["doc_id"]])
            assert (r["log_ppl"] is None) == (want is None)
            assert want is None or math.isclose(r["log_ppl"], want, rel_tol=1e-9)


def test_unseen_grams_back_off(spark, make_docs, texts):
    folder = shared_folder(spark, "test-model")
    levels = kn.fit(kn.count_grams(make_docs([(i, t) for i, t in enumerate(texts)])), folder)
    model = Brute(texts)
    asked = [b"zzzzz", b"the z", b" the ", b"qthe ", bytes([2, 2, 2, 2]) + b"q"]
    rows = [("en", int.from_bytes(g, "big")) for g in asked]
    got = {r["gram"]: r["log_p"] for r in kn.probabilities(levels, spark.createDataFrame(rows, "lang string, gram long")).collect()}
    for g in asked:
        assert math.isclose(got[int.from_bytes(g, "big")], math.log(model.p(g)), rel_tol=1e-9)
    other = kn.probabilities(levels, spark.createDataFrame([("xx", rows[0][1])], "lang string, gram long")).first()
    assert math.isclose(other["log_p"], math.log(0.5))


def test_probabilities_of_a_context_sum_to_less_than_one(spark, make_docs, texts):
    folder = shared_folder(spark, "test-model")
    table = kn.model_probabilities(kn.fit(kn.count_grams(make_docs([(i, t) for i, t in enumerate(texts)])), folder))
    sums = table.groupBy(F.shiftright("gram", 8).alias("c")).agg(F.sum(F.exp("log_p")).alias("s"))
    assert sums.where("s > 1 + 1e-9 OR s <= 0").count() == 0


def test_verdicts(make_docs):
    rng = random.Random(9)
    words = ["the", "house", "stands", "near", "a", "river", "and", "birds", "sing", "there", "every", "morning"]
    clean = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(80)]
    noise = "".join(chr(rng.randrange(33, 126)) for _ in range(900))
    junk = [(900, " ".join(noise[i : i + 6] for i in range(0, 900, 6)))]
    loop = [(901, "the river " * 100), (902, "too short"), (903, None), (904, "")]
    docs = make_docs([*clean, *junk, *loop, (905, clean[0][1], None)], extra=["n", "gram", "key"])
    got = {r["doc_id"]: r for r in kn.quality_rules(docs).collect()}
    assert all(got[i]["kept"] for i, _ in clean)
    assert not got[900]["kept"] and not got[900]["base_failed"]
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (901, 902, 903, 904))
    assert got[905]["kept"] and got[903]["perplexity"] is None
    assert kn.quality_rules(make_docs([])).count() == 0


def test_repeated_rows_count_as_often_as_they_occur(make_docs):
    text = " ".join(f"word{i % 7} and more" for i in range(60))
    rows = [(1, text), (1, text), (2, text + " end")]
    got = kn.quality_rules(make_docs(rows)).collect()
    assert len(got) == 3 and len({(r["doc_id"], r["perplexity"]) for r in got}) == 2


def test_no_language_and_an_empty_name_on_both_paths(spark, make_docs, texts):
    """Null, "" and a named language each have a model of their own, by broadcast and by shuffle."""
    langs = [None, "", "en"]
    rows = [(i, t, langs[i % 3]) for i, t in enumerate(texts)]
    docs, folder = make_docs(rows), shared_folder(spark, "test-model")
    table = kn.model_probabilities(kn.fit(kn.count_grams(docs), folder))
    models = {lang: Brute([t for _, t, x in rows if x == lang]) for lang in langs}
    for i, limit in enumerate((kn.MAX_GRAMS, 0)):
        for r in kn.score(docs, table, f"{folder}/{i}", limit).collect():
            _, text, lang = rows[r["doc_id"]]
            want = models[lang].log_ppl(text)
            assert (r["log_ppl"] is None) == (want is None)
            assert want is None or math.isclose(r["log_ppl"], want, rel_tol=1e-9)
