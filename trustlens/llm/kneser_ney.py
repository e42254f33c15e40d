"""Quality rules with an n-gram perplexity band per language.

**Model.** A document's words, joined by single blanks, are read as UTF-8 bytes; the model is a
modified Kneser-Ney model of order ``ORDER`` over them, one per language, counted over all documents.
Byte n-grams are counted per task in sorted hash arrays and summed by Spark, so the shuffle
carries a task's distinct n-grams and not its words (word n-grams are about as many as
the words themselves). An n-gram is one integer (the hash is a bijection of it and the
language). Lower orders, count-of-count discounts, back-off weights and
probabilities are joins and grouped sums over the distinct n-grams.

**Scoring.** Each n-gram's probability is kept in one array sorted by hash (with an index of
hash prefixes), broadcast only if the table is counted to hold at most ``MAX_GRAMS`` entries; a larger
one joins the documents' n-gram counts by a shuffle instead. Both ways sum the same
numbers.

**Bands.** A mean over n bytes scatters as 1 / sqrt(n), so deviations from the language's median
of log perplexity are scaled by sqrt(n). Median and median absolute deviation (MAD) are taken per
language over all documents that pass the base rules. A document's band is the median plus and minus
``SPREAD`` MADs / sqrt(n), at least ``LEAST_WIDTH``; the MAD counts as ``LEAST_MAD`` at least, so that
a language made up mostly of copies does not close the band. Below the lower band (repetitive) or
above the upper (unlike the language) a document is rejected.

**Cases.** Null, empty and blank texts have no words, fail the base rules and have a null
perplexity. A null language is a language of its own. Repeated rows are counted and scored as
often as they occur. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustlens.llm.common import materialize, shared_folder, stored_side, stored_table
from trustlens.llm.textbatch import mix, slices, span_hashes, text_bytes, windows, word_spans

ORDER = 5
#: Most n-grams that are broadcast (16 bytes each, and an index of up to 16 MB).
MAX_GRAMS = 4_000_000
#: A task hands on its counts when it holds this many n-grams. Affects the shuffle's size only.
HELD_GRAMS = 2_000_000
SPREAD = 8.0
LEAST_WIDTH = 0.05
LEAST_MAD = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"

SLICE_BYTES = 1 << 20
_PAD = 0x02
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


class SortedHashes:
    """Sorted 64-bit keys with an index of their prefixes for vectorised look-up."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(1, min(21, int(len(keys)).bit_length() + 1)))
        sizes = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << (64 - int(self.shift)))
        # one more entry than prefixes, and one more key than real ones, so that every prefix has a place
        self.first = np.append(0, np.cumsum(sizes)).astype(np.int32 if len(keys) < 1 << 31 else np.int64)
        self.padded = np.append(keys, np.uint64(0))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted key, -1 where it is absent."""
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int64)
        prefix = (wanted >> self.shift).astype(np.int64)
        out = self.first[prefix].astype(np.int64)
        # most are the first key of their prefix
        left = np.flatnonzero((self.padded[out] != wanted) | (out == len(self.keys)))
        at, end, wanted = out[left], self.first[prefix[left] + 1], wanted[left]
        out[left] = -1
        while len(left):
            go = np.flatnonzero((at < end) & (self.padded[at] < wanted))
            hit = np.flatnonzero((at < end) & (self.padded[at] == wanted))
            out[left[hit]] = at[hit]
            left, at, end, wanted = left[go], at[go] + 1, end[go], wanted[go]
        return out


def language_key(lang: str | None) -> np.uint64:
    """A language's part of its n-grams' keys; no language and the empty name are two languages."""
    if lang is None:
        return np.uint64(0x8F1BBCDCBFA53E0B)  # beyond any gram, so that no two languages share a key
    seed = np.frombuffer(lang.encode("utf-8"), np.uint8)
    return span_hashes(seed, np.array([0]), np.array([len(seed)]))[0] if len(seed) else np.uint64(1)


def _stream(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each text's words joined by single blanks, after ORDER - 1 pads, and the n + 1 bounds; a
    text without words is empty."""
    data, offsets = text_bytes(part.column("text"))
    row, starts, _ = word_spans(data, offsets)
    kept = ~_WHITE[data]
    later = np.zeros(len(row), dtype=bool)
    later[1:] = row[1:] == row[:-1]
    kept[starts[later] - 1] = True
    letters = np.where(_WHITE[data], np.uint8(0x20), data)[kept]
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kept, out=sums[1:])
    sizes = sums[offsets[1:]] - sums[offsets[:-1]]
    padded = np.where(sizes > 0, sizes + ORDER - 1, 0)
    bounds = np.append(0, np.cumsum(padded))
    out = np.full(int(bounds[-1]), _PAD, np.uint8)
    body = np.ones(len(out), dtype=bool)
    body[(bounds[:-1][sizes > 0][:, None] + np.arange(ORDER - 1)).ravel()] = False
    out[body] = letters
    return out, bounds


def _grams(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, gram, row) of each real byte's ORDER-gram; the key is hashed with the language."""
    stream, bounds = _stream(part)
    n = len(stream) - (ORDER - 1)
    if n <= 0:
        empty = np.zeros(0, np.uint64)
        return empty, empty, np.zeros(0, np.int64)
    gram = np.zeros(n, np.uint64)
    for i in range(ORDER):
        gram <<= np.uint64(8)
        gram |= stream[i : i + n]
    # windows that reach into the next text's pads are not grams
    whole = np.ones(n, dtype=bool)
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    whole[(inner[:, None] - np.arange(1, ORDER)).ravel()] = False
    gram = gram[whole]
    sizes = np.maximum(np.diff(bounds) - (ORDER - 1), 0)
    langs = part.column("lang").to_pylist()
    known = {lang: language_key(lang) for lang in set(langs)}
    seeds = np.array([known[lang] for lang in langs], np.uint64)
    return mix(gram ^ np.repeat(seeds, sizes)), gram, np.repeat(np.arange(part.num_rows), sizes)


class _Counter:
    """Counts of n-grams in sorted hash arrays."""

    def __init__(self):
        self.index, self.counts = SortedHashes(np.zeros(0, np.uint64)), np.zeros(0, np.int64)
        self.langs, self.grams = np.zeros(0, object), np.zeros(0, np.uint64)

    def add(self, part: pa.RecordBatch) -> None:
        key, gram, row = _grams(part)
        found = self.index.find(key)
        self.counts += np.bincount(found[found >= 0], minlength=len(self.counts))
        rest = np.flatnonzero(found < 0)
        if not len(rest):
            return
        new, where, n = np.unique(key[rest], return_index=True, return_counts=True)
        where = rest[where]
        at = np.searchsorted(self.index.keys, new)
        self.index = SortedHashes(np.insert(self.index.keys, at, new))
        self.counts, self.grams = np.insert(self.counts, at, n), np.insert(self.grams, at, gram[where])
        self.langs = np.insert(self.langs, at, np.array(part.column("lang").to_pylist(), object)[row[where]])

    def batches(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.counts), 100_000):
            here = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.langs[here].tolist(), pa.string()), pa.array(self.grams[here].view(np.int64)),
                 pa.array(self.counts[here])],
                ["lang", "gram", "n"],
            )


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram (the bytes as one number), n: the ORDER-grams of all texts and how often they occur."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                counter.add(part)
                if len(counter.counts) > HELD_GRAMS:
                    yield from counter.batches()
                    counter = _Counter()
        yield from counter.batches()

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _tail(order: int) -> Column:
    """The last ``order`` bytes of column gram."""
    return F.col("gram").bitwiseAND(F.lit((1 << (8 * order)) - 1).cast("long"))


def _context() -> Column:
    """Column gram without its last byte."""
    return F.shiftright("gram", 8)


def fit(grams: DataFrame, folder: str) -> list[DataFrame]:
    """The levels from order 1 up, each written to ``folder``: lang, gram, share (its discounted share of
    its context) and back_off (the weight its context leaves to the next lower order). ``grams``
    are the counted ORDER-grams (lang, gram, n). A context has at most one gram per character."""
    levels, counts = [], grams
    for order in range(ORDER, 0, -1):
        of = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0))
        cuts = []
        for i in (1, 2, 3):
            cut = i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0))
            cuts.append(F.greatest(F.lit(0.0), F.coalesce(cut, F.lit(0.5))).alias(f"d{i}"))
        discounts = stored_side(counts.groupBy("lang").agg(*of).select(F.col("lang").alias("of_lang"), *cuts))
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = counts.join(discounts, _same("lang", "of_lang")).select(
            "lang", "gram", _context().alias("context"), "n", F.least(discount, F.col("n")).alias("d")
        )
        within = Window.partitionBy("lang", "context")
        total = F.sum("n").over(within)
        share, back_off = (F.col("n") - F.col("d")) / total, F.sum("d").over(within) / total
        level = rows.select("lang", "gram", share.alias("share"), back_off.alias("back_off"))
        levels.insert(0, stored_table(level, f"{folder}/order-{order}"))
        # a lower order counts the distinct characters before each of its n-grams
        if order > 1:
            counts = counts.groupBy("lang", _tail(order - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
            counts = stored_table(counts, f"{folder}/counts-{order - 1}")
    return levels


def _flat(levels: list[DataFrame]) -> DataFrame:
    flat = levels[0].groupBy(F.col("lang").alias("f_lang")).agg((1.0 / (1 + F.count(F.lit(1)))).alias("lower"))
    return flat.select("f_lang", F.lit(0).cast("long").alias("f_gram"), "lower")


def model_probabilities(levels: list[DataFrame]) -> DataFrame:
    """lang, gram, log_p (the interpolated probability of the last character) of the model's own grams."""
    lower = _flat(levels)
    for order, level in enumerate(levels, 1):
        rows = level.withColumn("shorter", _tail(order - 1))
        rows = rows.join(lower, _same("lang", "f_lang") & (F.col("shorter") == F.col("f_gram")))
        out = rows.select("lang", "gram", (F.col("share") + F.col("back_off") * F.col("lower")).alias("p"))
        lower = out.select(F.col("lang").alias("f_lang"), F.col("gram").alias("f_gram"), F.col("p").alias("lower"))
    return out.select("lang", "gram", F.log("p").alias("log_p"))


def probabilities(levels: list[DataFrame], grams: DataFrame) -> DataFrame:
    """As ``model_probabilities`` for any distinct ORDER-grams (lang, gram), seen or not."""
    lower = _flat(levels)
    for order, level in enumerate(levels, 1):
        part = grams.select("lang", _tail(order).alias("gram")).distinct()
        part = part.withColumn("context", _context()).withColumn("shorter", _tail(order - 1))
        seen = level.select(F.col("lang").alias("s_lang"), F.col("gram").alias("s_gram"), "share")
        ahead = level.select(F.col("lang").alias("c_lang"), _context().alias("c_context"), "back_off")
        ahead = ahead.groupBy("c_lang", "c_context").agg(F.max("back_off").alias("back_off"))
        part = part.join(seen, _same("lang", "s_lang") & (F.col("gram") == F.col("s_gram")), "left")
        part = part.join(ahead, _same("lang", "c_lang") & (F.col("context") == F.col("c_context")), "left")
        part = part.join(lower, _same("lang", "f_lang") & (F.col("shorter") == F.col("f_gram")), "left")
        # a language without a model gives every character one chance in two
        p = F.coalesce("share", F.lit(0.0)) + F.coalesce("back_off", F.lit(1.0)) * F.coalesce("lower", F.lit(0.5))
        out = part.select("lang", "gram", p.alias("p"))
        lower = out.select(F.col("lang").alias("f_lang"), F.col("gram").alias("f_gram"), F.col("p").alias("lower"))
    return out.select("lang", "gram", F.log("p").alias("log_p"))


_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def base_rules(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, offsets = text_bytes(column)
    rows = len(offsets) - 1
    row, starts, ends = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    symbol = np.zeros(256, dtype=bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    n_words = np.bincount(row, minlength=rows)
    # three-word windows that occur twice in a text mark their words
    triple = windows(hashes, 3)
    inside = row[: len(triple)] == row[2:] if len(triple) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    _, back, n = np.unique(mix(triple[at] ^ mix(row[at].astype(np.uint64))), return_inverse=True, return_counts=True)
    twice = at[n[back] > 1] if len(at) else at
    marked = np.zeros(len(row), dtype=bool)
    for i in range(3):
        marked[twice + i] = True
    # lines with a word, equal to an earlier line of the text
    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    next_start = np.append(line_starts[1:], len(data))
    ended = (next_start > line_starts) & (data[np.maximum(next_start - 1, 0)] == 0x0A) if len(data) else np.zeros(0, bool)
    line_ends = next_start - ended
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_row = np.searchsorted(offsets, line_starts, "right") - 1
    lines = mix(span_hashes(data, line_starts, line_ends) ^ mix(line_row.astype(np.uint64)))
    _, kept = np.unique(lines, return_index=True)
    return {
        "n_words": n_words,
        "word_chars": _row_sums(((data & 0xC0) != 0x80) & ~_WHITE[data], offsets),
        "n_symbols": _row_sums(symbol[data], offsets),
        "n_dup_lines": np.bincount(line_row, minlength=rows) - np.bincount(line_row[kept], minlength=rows),
        "n_repeat_words": np.bincount(row[marked], minlength=rows),
    }


def _rules_and_score(table):
    """Task of doc_id, lang, the base rules and log_p (null without a table) of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if table is not None:
            index, log_p = SortedHashes(table.value[0]), table.value[1]
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                base = base_rules(part.column("text"))
                key, _, row = _grams(part)
                read = np.bincount(row, minlength=part.num_rows)
                total = np.zeros(part.num_rows)
                if table is not None:
                    total = np.bincount(row, weights=log_p[index.find(key)], minlength=part.num_rows)
                arrays = [part.column("doc_id"), part.column("lang"), part.column("key")]
                arrays += [pa.array(v.astype(np.int64)) for v in base.values()]
                arrays += [pa.array(read.astype(np.int64)), pa.array(total)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang", "key", *base, "read", "log_p"])

    return run


def _document_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, gram key, n) per document, for tables too large to broadcast."""
    for batch in batches:
        for part in slices(batch, limit=SLICE_BYTES):
            grams, _, row = _grams(part)
            keys = np.array(part.column("key").to_pylist(), np.int64)
            order = np.lexsort((grams, row))
            grams, row = grams[order], row[order]
            fresh = np.ones(len(row), dtype=bool)
            fresh[1:] = (np.diff(row) != 0) | (grams[1:] != grams[:-1])
            at = np.flatnonzero(fresh)
            n = np.diff(np.append(at, len(row)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[row[at]]), pa.array(grams[at].view(np.int64)), pa.array(n)], ["key", "gram_key", "n"]
            )


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        known = {lang: language_key(lang) for lang in set(langs)}
        seeds = np.array([known[lang] for lang in langs], np.uint64)
        keys = mix(batch.column("gram").to_numpy().view(np.uint64) ^ seeds)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("log_p")], ["gram_key", "log_p"])


def score(docs: DataFrame, table: DataFrame, folder: str, max_grams: int = MAX_GRAMS) -> DataFrame:
    """doc_id, lang, the base rules, and log_ppl (null without words) of every document; ``table`` has
    the probability of each of their n-grams."""
    spark = docs.sparkSession
    keyed = stored_table(table.mapInArrow(_keyed, "gram_key long, log_p double"), f"{folder}/sorted-hashes")
    n_grams = keyed.count()
    rows = docs.select("doc_id", "lang", "text", F.xxhash64("lang", "text").alias("key"))
    schema = f"doc_id long, lang string, key long, {_BASE}, read long, log_p double"
    if n_grams <= max_grams:
        held = keyed.toArrow()  # at most max_grams rows of 16 bytes
        keys = held["gram_key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        sent = spark.sparkContext.broadcast((keys[order], held["log_p"].to_numpy()[order]))
        scored = rows.mapInArrow(_rules_and_score(sent), schema)
    else:
        # texts that are equal share their sum, so it is computed once per language and text
        once = rows.select("lang", "text", "key").dropDuplicates(["key"])
        counts = once.mapInArrow(_document_grams, "key long, gram_key long, n long")
        sums = counts.join(keyed, "gram_key").groupBy("key").agg(F.sum(F.col("n") * F.col("log_p")).alias("log_p"))
        scored = rows.mapInArrow(_rules_and_score(None), schema).drop("log_p").join(sums, "key", "left")
    log_ppl = F.when(F.col("read") > 0, -F.col("log_p") / F.col("read"))
    return scored.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "read",
        log_ppl.alias("log_ppl"),
    )


def bands(scored: DataFrame) -> DataFrame:
    """lang, median (of log perplexity), mad (of its deviation times sqrt(read)) from the documents that
    pass the base rules."""
    usable = scored.where(~F.col("base_failed") & F.col("log_ppl").isNotNull())
    middle = usable.groupBy("lang").agg(F.percentile_approx("log_ppl", 0.5, 10_000).alias("median"))
    middle = stored_side(middle.withColumnRenamed("lang", "m_lang"))
    scaled = F.abs(F.col("log_ppl") - F.col("median")) * F.sqrt("read")
    away = usable.join(middle, F.col("lang").eqNullSafe(F.col("m_lang")))
    return away.groupBy("lang", "median").agg(F.percentile_approx(scaled, 0.5, 10_000).alias("mad")).select(
        F.col("lang").alias("band_lang"), "median", F.greatest(F.lit(LEAST_MAD), "mad").alias("mad")
    )


def quality_rules(docs: DataFrame, max_grams: int = MAX_GRAMS) -> DataFrame:
    """doc_id, the base rules, base_failed, kept, perplexity, lower and upper of every document."""
    docs = docs.select("doc_id", "lang", "text")
    folder = shared_folder(docs.sparkSession, "ngram-model")
    grams = stored_table(count_grams(docs), f"{folder}/counts-{ORDER}")
    table = model_probabilities(fit(grams, folder))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = materialize(score(docs, table, folder, max_grams).withColumn("base_failed", failed))
    out = scored.join(stored_side(bands(scored)), F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    half = F.greatest(F.lit(LEAST_WIDTH), SPREAD * F.col("mad") / F.sqrt(F.nullif(F.col("read"), F.lit(0))))
    out = out.withColumn("lower", F.col("median") - half).withColumn("upper", F.col("median") + half)
    within = F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(False))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & within).alias("kept"), F.exp("log_ppl").alias("perplexity"),
        F.exp("lower").alias("lower"), F.exp("upper").alias("upper"),
    )
