from __future__ import annotations

import random

from brute_lines import dedup
from pyspark.sql import functions as F

from trustlens.llm import line_variants
from llm_fixtures import make_docs, shipped  # noqa: F401


def _found(docs, **options):
    return {r["doc_id"]: (r["text"], r["n_lines"], r["n_exact"], r["n_near"]) for r in line_variants.dedup_lines(docs, **options).collect()}


def test_equals_brute_force(make_docs):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 16))] for _ in range(40)]
    rows = []
    for doc in range(60):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            words = list(rng.choice(base))
            change = rng.randrange(5)
            if change == 1:
                words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
            elif change == 2:
                words.insert(rng.randrange(len(words) + 1), f"x{rng.randrange(9)}")
            elif change == 3 and len(words) > 1:
                del words[rng.randrange(len(words))]
            lines.append(rng.choice([" ", "  ", "\t"]).join(words))
        rows.append((doc, "\n".join(lines + [""] * rng.randrange(2))))
    for near_words in (3, 8):
        assert _found(make_docs(rows), near_words=near_words) == dedup(rows, near_words)


def test_template_lines_keep_the_earliest(make_docs):
    """Hundreds of lines that differ in one word share one key: one earliest line stays."""
    rows = [(i, f"page {i} of the long report on all the things we saw") for i in range(300)]
    got = _found(make_docs(rows))
    assert got[0][0] == rows[0][1] and all(got[i] == ("", 1, 0, 1) for i in range(1, 300))


def test_cases(make_docs):
    same = "one two three four five six seven eight nine"
    rows = [(2, None), (3, ""), (4, " \n\t"), (5, same + "\n" + same), (5, same + "\n" + same), (None, same + " ten")]
    got = sorted(line_variants.dedup_lines(make_docs(rows, extra=["line", "gone", "key"])).collect(), key=lambda r: (r["doc_id"] or 0, r["n_lines"]))
    assert [tuple(r)[:2] for r in got if r["doc_id"] in (2, 3, 4)] == [(2, None), (3, ""), (4, " \n\t")]
    # the null id comes first, so its line stays and both rows of document 5 lose theirs alike
    assert [r["text"] for r in got if r["doc_id"] is None] == [same + " ten"]
    assert [tuple(r)[1:] for r in got if r["doc_id"] == 5] == [("", 2, 0, 2)] * 2
    assert line_variants.dedup_lines(make_docs([])).count() == 0


def test_edit_distance(spark):
    pairs = [("a b c", "a b c", True), ("a b c", "a x c", True), ("a b c", "a c", True), ("a c", "a b c", True),
             ("a b c", "b a c", False), ("a b c", "a", False), ("a b c d", "a x c y", False), ("a a a", "a a", True), ("a", "b", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    got = df.select(line_variants.within_one_edit(F.split("a", " "), F.split("b", " ")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
