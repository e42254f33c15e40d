"""Target-distribution importance resampling: hashed n-gram gains, then a distributed quickselect.

**Features.** Texts are lower-cased (A-Z only) and cut into words of digits, a-z and non-ASCII
characters. Every run of 1 to ``orders`` words, joined by one space, is a feature; its bucket is the
unsigned crc32 of its UTF-8 bytes modulo ``buckets``. All documents hold S features, s of them in a
bucket, all target texts T and t; a bucket's gain is
floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))).

**Scores.** The gains are one array of ``buckets`` integers; a document's weight is the floored mean
of its features' gains (0 without features) and its score adds Gumbel noise from a hash of its id,
so that the highest scores are a sample without replacement in proportion to exp(weight / 1000).

**Quickselect.** Of the n documents with at least ``least_words`` words the floor(percent n / 100)
highest scores are drawn. Rows have one composite key (score falling, id rising, then the other result
columns and a place), no two alike. Random rows of the open key interval are pivots; one
aggregate counts the rows below and at each pivot exactly, and the interval that holds the k-th
key stays, until a pivot is that key. Only the winners are sorted: a range sort writes them with
their place in their partition, and the partitions' row counts turn places into ranks.

**Scale.** Texts are read twice (counts, scores) and never shuffled. What a task gathers, and
what the driver sees, is bounded by ``buckets``, ``PIVOTS`` or the number of partitions. The scored
table (a few numbers per document) is written once; the passes of the quickselect read only
its key interval. No group and no row count is collected in one task.

**Cases.** Null and empty texts have no features, weight 0 and a score. A null id hashes like an
empty one, ranks after equal scores with an id, and is drawn like any. Repeated rows count, score
and rank one by one. A bucket no text uses has a gain, too. Empty tables give no rows; without
target texts all gains follow from t = T = 0. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustlens.llm.common import shared_folder, stored_table
from trustlens.llm.textbatch import slices, text_bytes

ORDERS = 1
BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = "2024"
#: Random keys that one pass of the quickselect counts against.
PIVOTS = 31
PIECE_BYTES = 1 << 20
#: Bytes of a feature up to which crc32 runs over arrays of features; longer ones go one by one.
SHORT = 48

#: Word bytes after lower-casing: digits, a-z and all bytes of non-ASCII characters; others are 0.
_FOLD = np.zeros(256, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _crc_table() -> np.ndarray:
    """crc32 of one byte (reflected polynomial 0xEDB88320), for all 256 bytes."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1).astype(np.uint32)
    return value


_CRC = _crc_table()


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each byte span ``data[start:end]``."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    order = np.argsort(-size, kind="stable")  # longest first: the spans still open are a prefix
    n_open = len(order) - np.searchsorted(size[order][::-1], np.arange(SHORT), "right")
    state, first = out.copy(), starts[order]
    long = int(np.searchsorted(-size[order], -SHORT, "left"))
    for i in range(SHORT):
        live = slice(long, max(int(n_open[i]), long))
        if live.start >= live.stop:
            break
        state[live] = _CRC[(state[live] ^ data[first[live] + i]) & 0xFF] ^ (state[live] >> 8)
    out[order] = ~state
    for j in order[:long]:
        out[j] = zlib.crc32(data[starts[j] : ends[j]].tobytes())
    return out


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, start, end) of each word of ``data`` (folded bytes, 0 between words) in order, by pieces
    of about ``limit`` bytes; words never cross a row or a piece."""
    at, n = 0, len(data)
    while at < n:
        to = min(at + limit, n)
        if to < n:  # back to the last gap or row end, or on to the next one if a word fills the piece
            gaps = np.flatnonzero(data[at:to] == 0)
            row_end = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            cut = max(at + int(gaps[-1]) + 1 if len(gaps) else at, row_end)
            while cut <= at:
                gaps = np.flatnonzero(data[to : to + limit] == 0)
                row_end = int(offsets[np.searchsorted(offsets, to, "left")])
                cut = min(to + int(gaps[0]) if len(gaps) else n, row_end)
                if not len(gaps) and cut > to + limit:
                    to, cut = to + limit, at
            to = cut
        part = data[at:to] != 0
        inner = offsets[(offsets > at) & (offsets < to)] - at
        fresh = np.ones(len(part), dtype=bool)
        fresh[1:] = ~part[:-1]
        fresh[inner] = True
        last = np.ones(len(part), dtype=bool)
        last[:-1] = fresh[1:] | ~part[1:]
        starts, ends = np.flatnonzero(part & fresh) + at, np.flatnonzero(part & last) + at + 1
        yield np.searchsorted(offsets, starts, "right") - 1, starts, ends
        at = to


def features(column: pa.Array, buckets: int = BUCKETS, orders: int = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, bucket) of the features of a text column, and the number of words, piece by piece."""
    raw, offsets = text_bytes(column)
    data = _FOLD[raw]
    held: list[tuple[int, bytes]] = []  # the last words, for runs that cross a piece
    for row, starts, ends in pieces(data, offsets):
        yield row, (crc32_spans(data, starts, ends) % np.uint32(buckets)).astype(np.int64), len(row)
        if orders == 1:
            continue
        words = held + [(int(r), data[s:e].tobytes()) for r, s, e in zip(row, starts, ends)]
        rows, found = [], []
        for i in range(len(held), len(words)):
            run = words[i][1]
            for j in range(i - 1, max(i - orders, -1), -1):
                if words[j][0] != words[i][0]:
                    break
                run = words[j][1] + b" " + run
                rows.append(words[i][0])
                found.append(zlib.crc32(run) % buckets)
        yield np.array(rows, np.int64), np.array(found, np.int64), 0
        held = words[-(orders - 1) :]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, orders: int = ORDERS) -> np.ndarray:
    """Features of all ``texts`` (column text) by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                for _, bucket, _ in features(part.column("text"), buckets, orders):
                    total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    partial = texts.select("text").mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Integer gain of each bucket from the feature counts of all documents and all target texts."""
    buckets = len(source)
    up = (target + 1).astype(float) * float(source.sum() + buckets)
    down = (source + 1).astype(float) * float(target.sum() + buckets)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, orders: int = ORDERS) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, total, words = (np.zeros(part.num_rows, np.int64) for _ in range(3))
                for row, bucket, n_words in features(part.column("text"), buckets, orders):
                    if not len(row):
                        continue
                    size = np.bincount(row, minlength=len(n))
                    n += size
                    words += size if n_words else 0
                    low = int(row[0])  # rows ascend: sum over each row's run, in integers
                    names, first = np.unique(row - low, return_index=True)
                    total[names + low] += np.add.reduceat(gain[bucket], first)
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                columns = [part.column("doc_id"), pa.array(words), pa.array(n), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """floor(1000 g) for a standard Gumbel draw g from a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


_KEY = ("falling", "no_id", "doc_id", "n_features", "weight", "place")


def _key() -> Column:
    """The composite key of a scored row as a struct that sorts best first; no two rows share one."""
    return F.struct((-F.col("score")).alias("falling"), F.col("doc_id").isNull().alias("no_id"), *_KEY[2:])


def _literal(row, kinds: dict[str, str]) -> Column:
    return F.struct(*[F.lit(row[c]).cast(kinds[c]).alias(c) for c in _KEY])


def kth_key(rows: DataFrame, n: int, k: int, seed: int = 7):
    """The k-th least key (1 <= k <= n) of ``rows`` (n of them), as a Row: random pivots, exact counts."""
    kinds = dict(rows.select(_key().alias("key")).select("key.*").dtypes)
    low = high = None  # keys are strictly between these
    rounds = 0
    while True:
        open_rows = rows
        for bound, above in ((low, True), (high, False)):
            if bound is not None:
                edge, at = _literal(bound, kinds), -F.lit(bound["falling"])
                open_rows = open_rows.where((F.col("score") <= at) & (_key() > edge) if above else (F.col("score") >= at) & (_key() < edge))
        draw = F.xxhash64("place", F.lit(seed + rounds))
        pivots = open_rows.select(_key().alias("key"), draw.alias("draw")).orderBy("draw", "key").limit(PIVOTS)
        pivots = sorted((r["key"] for r in pivots.collect()), key=_python_key)
        edges = [_literal(p, kinds) for p in pivots]
        counts = [F.count_if(_key() < e).alias(f"below{i}") for i, e in enumerate(edges)]
        counts += [F.count_if(_key() == e).alias(f"at{i}") for i, e in enumerate(edges)]
        seen = open_rows.agg(*counts).first()
        skipped = 0
        for i, p in enumerate(pivots):
            below, at = seen[f"below{i}"], seen[f"at{i}"]
            if below < k <= below + at:
                return p
            if k <= below:
                high = p
                break
            low, skipped = p, below + at
        k -= skipped
        rounds += 1


def _python_key(row):
    return (row["falling"], row["no_id"], 0 if row["doc_id"] is None else row["doc_id"], *[row[c] for c in _KEY[3:]])


def ranked(winners: DataFrame, path: str) -> DataFrame:
    """``winners`` with rank 1, 2, 3... by key: a range sort, and row counts of its partitions."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight", "place"]
    at = F.monotonically_increasing_id()
    sort = winners.orderBy(*order)
    stored = stored_table(sort.withColumn("part", F.shiftright(at, 33)).withColumn("nth", at.bitwiseAND(F.lit((1 << 33) - 1))), path)
    sizes = stored.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per sorted partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return stored.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("nth") + 1)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS, orders: int = ORDERS, seed: str = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null if undrawn) of every document."""
    gain = gains(bucket_counts(docs, buckets, orders), bucket_counts(target, buckets, orders))
    folder = shared_folder(docs.sparkSession, "target-resampling")
    scored = weights(docs, gain, orders).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stored_table(scored.withColumn("place", F.monotonically_increasing_id()), f"{folder}/scored")
    eligible = scored.where(F.col("n_words") >= least_words)
    n = eligible.count()
    k = percent * n // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*columns, none)
    edge = kth_key(eligible, n, k)
    kinds = dict(scored.select(_key().alias("key")).select("key.*").dtypes)
    wins = (F.col("n_words") >= least_words) & (_key() <= _literal(edge, kinds))
    drawn = ranked(scored.where(wins), f"{folder}/drawn")
    return scored.where(~wins).select(*columns, none).unionAll(drawn.select(*columns, F.col("rank").cast("long")))
