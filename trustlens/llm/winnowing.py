"""Benchmark decontamination by winnowing fingerprints.

Texts become words (A-Z lowered; maximal runs of a-z, digits and non-ASCII characters). Every
``K``-word gram is hashed, and of each run of ``SLIDE`` consecutive grams the least hash (the
leftmost of equals) is a fingerprint, on the document and on the benchmark side alike. Two
texts that share ``SPAN`` = K + SLIDE - 1 words in a row share the fingerprint of that very run at
the same place in it, so joining fingerprints and extending each hit along its diagonal
(document position less item position), word by word, finds every shared window and only
those. Benchmark items shorter than ``SPAN`` words are one window each; fingerprints cannot
promise those, so their whole hash joins with the document grams of that length.

Only the hit rows cross a shuffle: the benchmark's fingerprints are broadcast if they are
counted small, else both sides shuffle on the hash; the texts are read again only for
documents with a hit. DataFrame functions only.

**Cases.** Null, empty and wordless texts have no words and no hits; a wordless item has no
window. Repeated rows are scored alike, each with its own output row. Items that share an id are
one item; an item without an id marks words but is not counted or listed. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlens.llm.common import materialize
from trustlens.plans.sizing import broadcast_if_small

SPAN = 10
K = 5
SLIDE = SPAN - K + 1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The least hash and its place (0 to SLIDE - 1) share one long: its low bits hold the place.
_PLACE_BITS = (SLIDE - 1).bit_length()
_PLACE = (1 << _PLACE_BITS) - 1


def bench_words(text: Column) -> Column:
    """Array of a text's words; empty for null."""
    found = F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BREAK), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def _positions(last: Column) -> Column:
    """0 .. last, empty if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def fingerprints(rows: DataFrame, keys: list[str], short: list[int]) -> DataFrame:
    """``keys`` and (fp, pos) of each fingerprint of column ``words``; with the grams of each
    length in ``short`` as well. The steps stay separate projections: each array is used
    several times by the next."""
    n = F.size("hashes")
    out = rows.select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    grams = F.transform(
        _positions(n - K),
        lambda i: F.shiftleft(
            F.shiftright(F.xxhash64(*(_at("hashes", i + j) for j in range(K))), _PLACE_BITS), _PLACE_BITS
        ),
    )

    def whole_grams(size: int) -> Column:
        return F.transform(
            _positions(n - size),
            lambda i: F.struct(
                F.xxhash64(F.lit(size), *(_at("hashes", i + j) for j in range(size))).alias("fp"), i.alias("pos")
            ),
        )

    extra = [whole_grams(size) for size in short]
    out = out.select(*keys, grams.alias("grams"), *(x.alias(f"short_{i}") for i, x in enumerate(extra)))
    kept = [F.col(f"short_{i}") for i in range(len(extra))]
    # start of the window and place of its least gram, in one long
    least = F.transform(
        _positions(F.size("grams") - SLIDE),
        lambda j: j
        + F.least(*(_at("grams", j + i).bitwiseOR(F.lit(i).cast("long")) for i in range(SLIDE))).bitwiseAND(
            F.lit(_PLACE).cast("long")
        ),
    )
    out = out.select(*keys, "grams", *kept, F.array_distinct(least).alias("places"))
    marks = F.transform(
        "places", lambda p: F.struct(_at("grams", p.cast("int")).alias("fp"), p.cast("int").alias("pos"))
    )
    out = out.select(*keys, F.explode(F.concat(marks, *kept)).alias("mark"))
    return out.select(*keys, "mark.fp", "mark.pos")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """The benchmark's distinct items: item_id, item_hash, words (one at least)."""
    items = benchmark.select("item_id", F.xxhash64("text").alias("item_hash"), bench_words(F.col("text")).alias("words"))
    return items.where(F.size("words") > 0).dropDuplicates(["item_id", "item_hash"])


def shared_windows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every occurrence of a benchmark window: doc_id, doc_hash (of the text), item_id, start (word
    position in the document), size."""
    items = materialize(item_windows(benchmark))
    size = F.size("words")
    short = [r[0] for r in items.where(size < SPAN).select(size.alias("n")).distinct().orderBy("n").collect()]
    item_keys = ["item_id", "item_hash"]
    long_marks = fingerprints(items.where(size >= SPAN), item_keys, [])
    if short:
        whole = F.lit(None).cast("long")
        for n in short:
            whole = F.when(size == n, F.xxhash64(F.lit(n), *(F.xxhash64(F.get("words", F.lit(j))) for j in range(n)))).otherwise(whole)
        short_marks = items.where(size < SPAN).select(*item_keys, whole.alias("fp"), F.lit(0).alias("pos"))
        long_marks = long_marks.unionAll(short_marks)
    marks = broadcast_if_small(
        materialize(long_marks.select(F.col("fp"), F.col("pos").alias("item_pos"), *item_keys))
    )
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("doc_hash"))
    doc_keys = ["doc_id", "doc_hash"]
    doc_marks = fingerprints(texts.select(*doc_keys, bench_words(F.col("text")).alias("words")), doc_keys, short)
    hits = materialize(
        doc_marks.join(marks, "fp")
        .select(*doc_keys, *item_keys, (F.col("pos") - F.col("item_pos")).alias("diagonal"))
        .distinct()
    )
    wanted = broadcast_if_small(materialize(hits.select(*doc_keys).distinct()))
    same_doc = [F.col(f"t.{k}").eqNullSafe(F.col(f"w.{k}")) for k in doc_keys]
    found = texts.alias("t").join(wanted.alias("w"), same_doc, "left_semi").dropDuplicates(doc_keys)
    found = found.select(*doc_keys, bench_words(F.col("text")).alias("words"))
    extended = (
        hits.alias("h")
        .join(found.alias("d"), [F.col(f"h.{k}").eqNullSafe(F.col(f"d.{k}")) for k in doc_keys])
        .join(items.alias("i"), [F.col(f"h.{k}").eqNullSafe(F.col(f"i.{k}")) for k in item_keys])
        .select(
            *(F.col(f"h.{k}") for k in [*doc_keys, "item_id", "diagonal"]),
            F.col("d.words").alias("doc_words"), F.col("i.words").alias("item_words"),
            F.least(F.lit(SPAN), F.size("i.words")).alias("size"),
        )
    )
    diagonal = F.col("diagonal")
    first = F.greatest(F.lit(0), -diagonal)
    last = F.least(F.size("item_words"), F.size("doc_words") - diagonal) - F.col("size")
    starts = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    equal = F.filter(
        starts,
        lambda i: F.slice("doc_words", i + diagonal + 1, F.col("size")) == F.slice("item_words", i + 1, F.col("size")),
    )
    return extended.select(
        *doc_keys, "item_id", F.explode(F.transform(equal, lambda i: i + diagonal)).alias("start"), "size"
    )


def contaminated_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """hit_doc_id and hit_doc_hash (xxhash64 of the text) of the documents with a shared window."""
    shared = shared_windows(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    return shared.select(F.col("doc_id").alias("hit_doc_id"), F.col("doc_hash").alias("hit_doc_hash")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any shared window), items (ids of
    the items with a shared window, sorted as strings), contaminated."""
    docs = docs.select("doc_id", "text")
    benchmark = benchmark.select("item_id", "text")
    keys = ["doc_id", "doc_hash"]
    shared = materialize(shared_windows(docs, benchmark))
    covered = shared.select(*keys, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("at")).distinct()
    n_hit = covered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hit"))
    named = shared.select(*keys, F.col("item_id").cast("string").alias("item")).distinct()
    items = named.groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("items"))
    hit = n_hit.alias("n").join(items.alias("i"), [F.col(f"n.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys]).select(
        *(F.col(f"n.{k}").alias(f"hit_{k}") for k in keys), "n_hit", "items"
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), F.size(bench_words(F.col("text"))).alias("n_words"))
    out = rows.join(hit, [F.col(k).eqNullSafe(F.col(f"hit_{k}")) for k in keys], "left")
    hits = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        hits.cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (hits > 0).alias("contaminated"),
    )
