"""Line dedup by a deletion-neighbourhood join, within one word edit.

A line is its sequence of words. Lines of equal words are exact repeats. Lines of at least
``NEAR_WORDS`` words are also compared within one word inserted, deleted or replaced: every line emits
its deletion variants (itself without one word) as hashed keys, and

- two lines whose variants without word i are equal differ in word i alone (replacement),
- a line that equals a variant of another is that line without a word (deletion, insertion).

Only the earliest line per key is asked for, so a key is a grouped minimum and a join, never the
pairs of its lines: thousands of lines that differ in one number cost one row each. The pair of
each line and its earliest neighbour is verified on the words (edit distance at most 1) and the
line is dropped; the earliest line of each neighbourhood stays.

Variants are many (one per word), so a filter that loses nothing goes first: two lines within one edit
share their first or their last half, counted from the shorter length. Only lines that share such a
half with a different line emit variants.

**Cases.** The order of lines is (doc_id with null first, text hash, line number). Rows equal in id and
text are one document with several rows: they keep the same lines. Null, empty and
blank texts and lines without words are kept as they are; a null text stays null. Shorter lines than
``NEAR_WORDS`` are only compared exactly. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlens.llm.common import shared_folder, stored_table, words
from trustlens.llm.textbatch import mix, slices, span_hashes, text_bytes, word_spans
from trustlens.plans.sizing import broadcast_if_small

NEAR_WORDS = 8

_U = np.uint64
#: The prime 2**61 - 1, modulo which the lines' polynomials are taken, and their base.
_PRIME = (1 << 61) - 1
_FACTOR = 0x1E3779B97F4A7C15


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for any 64-bit x."""
    x = (x & _U(_PRIME)) + (x >> _U(61))
    return np.where(x >= _U(_PRIME), x - _U(_PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for a and b below it, from 31-bit halves (2**61 is 1)."""
    low, half = _U((1 << 31) - 1), _U(31)
    a_high, a_low, b_high, b_low = a >> half, a & low, b >> half, b & low
    middle = a_low * b_high + a_high * b_low
    high = a_high * b_high * _U(2) + (middle >> _U(30))
    return _fold(_fold(high + ((middle & _U((1 << 30) - 1)) << half)) + _fold(a_low * b_low))


def _minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _fold(a + (_U(_PRIME) - b))


def _running(values: np.ndarray) -> np.ndarray:
    """Prefix sums modulo the prime of values below it: high and low halves are summed apart."""
    low, high = np.cumsum(values & _U(0xFFFFFFFF), dtype=_U), np.cumsum(values >> _U(32), dtype=_U)
    return _fold(_fold(low) + _times(_fold(high), _U(1 << 32)))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo the prime, doubled block by block."""
    out = np.ones(1, dtype=_U)
    while len(out) < n:
        out = np.append(out, _times(out, _U(pow(base, len(out), _PRIME))))
    return out[:n]


class Lines:
    """The lines with words of a batch: row, line number, word count, and the prefix sums of a polynomial
    hash over their words modulo the prime 2**61 - 1."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        row, starts, ends = word_spans(data, offsets)
        hashes = span_hashes(data, starts, ends)
        breaks = np.flatnonzero(data == 0x0A)
        before = np.searchsorted(breaks, starts)
        line = before - np.searchsorted(breaks, offsets[:-1])[row] if len(row) else before
        fresh = np.ones(len(row), dtype=bool)
        fresh[1:] = (np.diff(row) != 0) | (np.diff(line) != 0)
        self.first = np.flatnonzero(fresh)
        self.size = np.diff(np.append(self.first, len(row)))
        self.row, self.line = row[self.first], line[self.first]
        longest = int(self.size.max()) if len(self.size) else 0
        up = _powers(_FACTOR, longest + 2)
        self.down = _powers(pow(_FACTOR, -1, _PRIME), longest + 2)
        inside = np.arange(len(row)) - np.repeat(self.first, self.size)
        self.sums = np.append(_U(0), _running(_times(_fold(hashes), up[inside])))
        begin, end = starts[self.first], ends[self.first + self.size - 1] if len(self.first) else starts
        self.spans, self.data = (begin, end), data

    def prefix(self, of: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sum over the first n words of each line."""
        return _minus(self.sums[self.first[of] + n], self.sums[self.first[of]])

    def suffix(self, of: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sum over the last n words, as if they stood at the front."""
        skip = self.size[of] - n
        return _times(_minus(self.prefix(of, self.size[of]), self.prefix(of, skip)), self.down[skip])

    def keys(self) -> np.ndarray:
        of = np.arange(len(self.first))
        return _key(self.prefix(of, self.size), self.size)

    def halves(self) -> list[np.ndarray]:
        """Keys of the first and last half for the length itself and one less (as the longer line)."""
        of, out = np.arange(len(self.first)), []
        for length in (self.size, self.size - 1):
            half = length // 2
            out.append(_key(self.prefix(of, half), length * 2))
            out.append(_key(self.suffix(of, half), length * 2 + 1))
        return out

    def variants(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, deleted word, key of the rest) of every deletion variant of the lines ``of``."""
        size = self.size[of]
        line = np.repeat(of, size)
        word = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
        rest = _minus(self.prefix(line, self.size[line]), self.prefix(line, word + 1))
        return line, word, _key(_fold(self.prefix(line, word) + _times(rest, self.down[1])), self.size[line] - 1)


def _key(sums: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(sums ^ mix(length.astype(_U) + _U(7)))


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == _U else values.astype(np.int64))


def _line_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            lines = Lines(part.column("text"))
            of_row = pa.array(lines.row)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(of_row), part.column("doc_hash").take(of_row), _long(lines.line),
                 _long(lines.keys()), _long(lines.size), *map(_long, lines.halves())],
                ["doc_id", "doc_hash", "line", "key", "size", "h0", "h1", "h2", "h3"],
            )


def _variant_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=1 << 20):
            lines = Lines(part.column("text"))
            keys = lines.keys()
            wanted = [set(x) for x in part.column("wanted").to_pylist()]
            chosen = [i for i, (r, n) in enumerate(zip(lines.row.tolist(), lines.line.tolist())) if n in wanted[r]]
            line, word, rest = lines.variants(np.array(chosen, np.int64))
            begin, end = lines.spans
            text = np.full(len(line), None, object)
            at = np.flatnonzero(word == 0)
            raw = lines.data
            text[at] = [raw[begin[i] : end[i]].tobytes().decode("utf-8") for i in line[at]]
            of_row = pa.array(lines.row[line])
            yield pa.RecordBatch.from_arrays(
                [_long(keys[line]), _long(word), _long(rest), part.column("doc_id").take(of_row),
                 part.column("doc_hash").take(of_row), _long(lines.line[line]), pa.array(text, pa.string())],
                ["key", "word", "rest", "doc_id", "doc_hash", "line", "text"],
            )


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by at most one word inserted, deleted or replaced: what their
    common start and end leave of the longer is one word at most."""

    def common(x: Column, y: Column) -> Column:
        n = F.least(F.size(x), F.size(y))
        same = F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda u, v: u == v)
        at = F.array_position(same, False).cast("int")
        return F.when(at > 0, at - 1).otherwise(n)

    longest, shortest = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    met = common(a, b) + common(F.reverse(a), F.reverse(b))
    return (longest - shortest <= 1) & (F.least(met, shortest) >= longest - 1)


def duplicate_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc_id, doc_hash, line (from 0), near (false: equal words) of every line that an earlier one repeats."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), "text")
    place = ["doc_id", "doc_hash", "line"]
    folder = shared_folder(docs.sparkSession, "line-variants")
    rows = keyed.mapInArrow(
        _line_rows,
        "doc_id long, doc_hash long, line long, key long, size long, h0 long, h1 long, h2 long, h3 long",
    )
    first = rows.groupBy("key").agg(
        F.min(F.struct(*place)).alias("at"), *(F.first(c).alias(c) for c in ("size", "h0", "h1", "h2", "h3"))
    )
    first = stored_table(first, f"{folder}/first")
    # lines that share a half with a different line
    long_lines = first.where(F.col("size") >= near_words)
    halves = long_lines.select("key", "at", F.explode(F.array_distinct(F.array("h0", "h1", "h2", "h3"))).alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    asked = stored_table(halves.join(shared, "half", "left_semi").select("key", "at").distinct(), f"{folder}/asked")
    wanted = asked.groupBy(F.col("at.doc_id").alias("w_id"), F.col("at.doc_hash").alias("w_hash")).agg(
        F.collect_set("at.line").alias("wanted")
    )
    wanted = broadcast_if_small(stored_table(wanted, f"{folder}/wanted"))
    same_doc = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("doc_hash") == F.col("w_hash"))
    texts = keyed.join(wanted, same_doc).select("doc_id", "doc_hash", "text", "wanted")
    # rows equal in id and text give equal variants; none of what follows counts them twice
    made = texts.mapInArrow(
        _variant_rows, "key long, word long, rest long, doc_id long, doc_hash long, line long, text string"
    )
    made = stored_table(made, f"{folder}/variants")
    variants = made.select("key", "word", "rest", F.struct(*place).alias("at"))
    # the earliest line per key: equal without the same word; equal to the rest; whose rest it is
    least = F.min(F.struct("at", F.col("key").alias("other"))).alias("found")
    several = F.min("key") < F.max("key")
    by_word = variants.groupBy("rest", "word").agg(least, several.alias("several")).where("several").drop("several")
    replaced = variants.join(by_word, ["rest", "word"]).select("key", "at", "found")
    full = asked.select(F.col("key").alias("rest"), F.struct("at", F.col("key").alias("other")).alias("found"))
    deleted = variants.join(full, "rest").select("key", "at", "found")
    by_rest = variants.groupBy(F.col("rest").alias("match")).agg(least)
    inserted = asked.join(by_rest, F.col("key") == F.col("match")).select("key", "at", "found")
    near = replaced.unionAll(deleted).unionAll(inserted).where(F.col("found.at") < F.col("at"))
    near = near.groupBy("key").agg(F.min("found").alias("found")).select("key", F.col("found.other").alias("other"))
    line_text = made.where("text IS NOT NULL").select("key", "text")
    pairs = near.join(line_text, "key").join(
        line_text.select(F.col("key").alias("other"), F.col("text").alias("other_text")), "other"
    )
    pairs = pairs.select("key", words(F.col("text")).alias("a"), words(F.col("other_text")).alias("b"))
    verified = pairs.where(within_one_edit(F.col("a"), F.col("b"))).select("key", F.lit(True).alias("is_near"))
    # every occurrence: later than the first of its key, or of a line near an earlier one
    verified = stored_table(verified.distinct(), f"{folder}/near")
    decided = first.join(verified, "key", "left").select("key", "at", "is_near")
    occurrences = rows.select("key", *place).join(decided, "key")
    dropped = occurrences.where(F.col("is_near") | (F.struct(*place) > F.col("at")))
    return dropped.select(*place, F.coalesce("is_near", F.lit(False)).alias("near"))


def dedup_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc_id, text without the dropped lines, n_lines (lines with words), n_exact and n_near (dropped)."""
    dropped = duplicate_lines(docs.select("doc_id", "text"), near_words)
    per_doc = dropped.groupBy(F.col("doc_id").alias("d_id"), F.col("doc_hash").alias("d_hash")).agg(
        F.collect_set(F.col("line").cast("int")).alias("gone"), F.collect_set(F.when(F.col("near"), F.col("line"))).alias("near")
    )
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("doc_hash"))
    out = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("doc_hash") == F.col("d_hash")), "left")
    out = out.select("doc_id", "text", "gone", "near", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.concat_ws("\n", F.transform(F.array_sort(kept), lambda i: F.get("lines", i)))
    )
    gone = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    near = F.coalesce(F.size("near"), F.lit(0)).cast("long")
    worded = F.size(F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    return out.select(
        "doc_id", text.alias("text"), worded.alias("n_lines"),
        (F.when(F.col("gone").isNull(), 0).otherwise(gone) - near).alias("n_exact"), near.alias("n_near"),
    )
