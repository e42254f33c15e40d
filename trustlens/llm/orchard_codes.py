"""Vector code compression: product codebooks trained and searched by Orchard's method.

A vector becomes integers floor(1024 * x), cut into ``PARTS`` equal consecutive parts. Each part
position has its own codebook of at most ``ENTRIES`` entries, which starts as that part of the
vectors with the least ids and moves through ``ROUNDS`` rounds of nearest assignment and floored
means. The code of a vector is the index of the nearest entry of each part.

**Orchard search.** For every entry a list of all entries by distance from it is kept. A part starts
at the nearest of a few probe entries and walks the list of its current entry: an unvisited entry
is marked and compared; when it is nearer (or as near with a lower index) the part jumps to that
entry's list. It stops at the first list entry farther from the current one than twice the
current distance, as by the triangle inequality nothing beyond can be as near. All numbers are
integers, so the bound and the ties are exact: the result is the nearest entry, the lowest index
among equals. Many parts walk their lists together, ``BLOCK`` entries a step.

**Scale.** Vectors are stored once as integers (zstd Parquet in the shared folder); every round is
one pass of Arrow batches over them that gives at most ``PARTS * ENTRIES`` partial sums a task,
added up by Spark. Only codebooks (bounded by the parameters) reach the driver. The label sums are
pre-aggregated; they are broadcast when counted to be few, else joined by shuffle with each
label spread over ``SALTS`` keys, so that a hot label is no single task's.

**Cases.** Rows whose vector is null or holds null or non-finite components are dropped; so are
vectors without components or of another length than the least id's (ids ascending, null ids last,
then the vector), and vectors whose length the parts do not divide. Integers beyond 2**26 are
held at 2**26, so that distances fit 64 bits. Rows without an id are coded like the others and
are the last to start a codebook; repeated rows all count. With fewer rows than entries the
codebooks are that much smaller; an empty table gives no rows. Null labels are one group.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlens.llm.common import MAX_BROADCAST_ROWS, shared_folder, stored_table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LIMIT = 1 << 26
#: List entries that a step compares, probe entries of a start, vectors searched together.
BLOCK = 16
PROBES = 16
TOGETHER = 1 << 15
SALTS = 32
#: Squared distances below this are exact in float64, with all products and sums on the way.
_EXACT = 1 << 50


def integer_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, integers) of the usable vectors of a list column: ``dim`` components, all finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()  # without the values of null rows
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])  # a null component is NaN here
    rows = np.flatnonzero((lengths == dim) & (bad[bounds[1:]] == bad[bounds[:-1]]))
    whole = np.floor(np.where(np.isfinite(values), values, 0) * SCALE).clip(-LIMIT, LIMIT).astype(np.int64)
    return rows, whole[bounds[rows][:, None] + np.arange(dim)]


def usable_rows(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """vec_id, label and the vector ``name`` of the rows that may be coded, whatever their length."""
    fine = ~F.exists(name, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", "label", name).where(F.col(name).isNotNull() & (F.size(name) > 0) & fine)


def seeds(vectors: DataFrame, name: str = "embedding", entries: int = ENTRIES, parts: int = PARTS) -> np.ndarray:
    """The integer vectors of the ``entries`` least ids, one row each (0 rows if there are none)."""
    least = [F.col("vec_id").asc_nulls_last(), F.col(name).asc()]
    rows = usable_rows(vectors, name).where(F.size(name) % parts == 0)
    first = rows.orderBy(*least).limit(1).collect()
    if not first:
        return np.zeros((0, 0), np.int64)
    dim = len(first[0][name])
    rows = rows.where(F.size(name) == dim).orderBy(*least).limit(entries).collect()
    found = np.array([r[name] for r in rows], dtype=np.float64)
    return np.floor(found * SCALE).clip(-LIMIT, LIMIT).astype(np.int64)


class Orchard:
    """Nearest-entry search in one codebook (entries by components, integers)."""

    def __init__(self, entries: np.ndarray, block: int = BLOCK):
        k = len(entries)
        self.entries = entries
        own = self._distances(entries, np.arange(k))
        self.steps = np.arange(block)
        self.lists = np.argsort(own, axis=1, kind="stable")
        self.reach = np.take_along_axis(own, self.lists, axis=1)
        # a block may reach past a list's end: repeat the last name there, out of reach
        self.lists = np.pad(self.lists, ((0, 0), (0, block)), "edge")
        self.reach = np.pad(self.reach, ((0, 0), (0, block)), constant_values=np.iinfo(np.int64).max)
        self.probes = np.arange(0, k, max(1, k // PROBES))
        self.compared = 0

    def _distances(self, x: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Squared distances from ``x`` to the entries ``names``, exact."""
        x, entries, square = self._numbers(x)
        return ((x * x).sum(axis=1)[:, None] + square[names] - 2 * (x @ entries[names].T)).astype(np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row of ``x``."""
        n, k = len(x), len(self.entries)
        start = self._distances(x, self.probes)
        at = start.argmin(axis=1)
        best, current = start[np.arange(n), at], self.probes[at].astype(np.int64)
        visited = np.zeros((n, k), dtype=bool)
        visited[:, self.probes] = True
        place = np.zeros(n, dtype=np.int64)
        x, entries, square = self._numbers(x)
        x2 = (x * x).sum(axis=1)
        active = np.arange(n)
        while len(active):
            c, p = current[active], place[active]
            slot = (c * self.lists.shape[1] + p)[:, None] + self.steps  # past the end of a list nothing is in reach
            names, reach = self.lists.ravel()[slot], self.reach.ravel()[slot]
            within = reach <= 4 * best[active][:, None]
            mark = (active * k)[:, None] + names
            fresh = within & ~visited.ravel()[mark]
            visited.ravel()[mark[fresh]] = True
            self.compared += int(fresh.sum())
            dots = np.matmul(entries.take(names.ravel(), axis=0).reshape(*names.shape, -1), x[active][:, :, None])[:, :, 0]
            near = (x2[active][:, None] + square[names] - 2 * dots).astype(np.int64)
            near[~fresh] = np.iinfo(np.int64).max
            least = near.min(axis=1)
            name = np.where(near == least[:, None], names, k).min(axis=1)
            jump = fresh.any(axis=1) & ((least < best[active]) | ((least == best[active]) & (name < c)))
            moved = active[jump]
            place[active] += len(self.steps)
            best[moved], current[moved], place[moved] = least[jump], name[jump], 0
            active = active[jump | within[:, -1]]
        return current, best

    def _numbers(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``x``, the entries and the entries' squares, as floats where all products and sums stay exact."""
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        kind = np.float64 if x.shape[1] * (2 * most) ** 2 < _EXACT else np.int64
        entries = self.entries.astype(kind)
        return x.astype(kind), entries, (entries * entries).sum(axis=1)


def _stored_vectors(vectors: DataFrame, name: str, dim: int, path: str) -> DataFrame:
    """vec_id, label, whole (the integers as little-endian 32 bits) of the usable vectors, written once."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, whole = integer_vectors(batch.column(2), dim)
            kept = batch.take(pa.array(rows))
            packed = pa.array([r.tobytes() for r in whole.astype("<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), packed], ["vec_id", "label", "whole"])

    kinds = dict(vectors.select("vec_id", "label").dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, whole binary"
    return stored_table(vectors.select("vec_id", "label", name).mapInArrow(convert, schema), path)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to about ``TOGETHER`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= TOGETHER:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _whole(table: pa.Table, dim: int) -> np.ndarray:
    data = b"".join(table.column("whole").to_pylist())
    return np.frombuffer(data, "<i4").reshape(-1, dim).astype(np.int64)


def _sums(stored: DataFrame, books: np.ndarray, dim: int) -> np.ndarray:
    """(part, entry, 1 + width): rows and component sums of the parts nearest to each entry."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Orchard(books[p]) for p in range(parts)]
        total = np.zeros((parts, entries, 1 + width), np.int64)
        for table in _gathered(batches):
            whole = _whole(table, dim)
            for p, search in enumerate(searches):
                x = whole[:, p * width : (p + 1) * width]
                code, _ = search.nearest(x)
                order = np.argsort(code, kind="stable")
                names, first = np.unique(code[order], return_index=True)
                total[p, names, 1:] += np.add.reduceat(x[order], first, axis=0)
                total[p, :, 0] += np.bincount(code, minlength=entries)
        part, entry = np.nonzero(total[:, :, 0])
        if len(part):
            columns = [part, entry, *total[part, entry].T]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names_)

    names_ = ["part", "entry", *[f"s{i}" for i in range(1 + width)]]
    partial = stored.select("whole").mapInArrow(add, ", ".join(f"{c} long" for c in names_))
    rows = partial.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names_[2:]]).collect()
    out = np.zeros((parts, entries, 1 + width), np.int64)
    for r in rows:
        out[r[0], r[1]] = r[2:]
    return out


def train(stored: DataFrame, start: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position) after ``rounds`` rounds over the stored vectors."""
    dim = start.shape[1]
    books = np.ascontiguousarray(start.reshape(len(start), parts, dim // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        total = _sums(stored, books, dim)
        used = total[:, :, 0] > 0
        books = books.copy()
        books[used] = total[used][:, 1:] // total[used][:, :1]  # floors go down
    return books


def assign(stored: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error of every stored vector."""
    parts, _, width = books.shape

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Orchard(books[p]) for p in range(parts)]
        for table in _gathered(batches):
            whole = _whole(table, parts * width)
            codes, error = np.zeros((len(whole), parts), np.uint8), np.zeros(len(whole), np.int64)
            for p, one in enumerate(searches):
                code, far = one.nearest(whole[:, p * width : (p + 1) * width])
                codes[:, p] = code
                error += far
            text = pa.array([c.tobytes().hex() for c in codes], pa.string())
            columns = [table.column("vec_id"), table.column("label"), text, pa.array(error)]
            yield from pa.table(dict(zip(("vec_id", "label", "code", "error"), columns))).to_batches()

    kinds = dict(stored.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    return stored.mapInArrow(search, schema)


def _with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the error summed over equal labels, nulls together."""
    label = [F.col("label").isNull().alias("no_label"), F.col("label").alias("named")]
    totals = coded.groupBy(*label).agg(F.sum("error").alias("label_error"))
    rows = coded.select("*", *label)
    keys = ["no_label", "named"]
    few = coded.select("label").distinct().limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    if few:
        totals = F.broadcast(totals)
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
        totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
        keys.append("salt")
    other = totals.select(*[F.col(k).alias(f"of_{k}") for k in keys], "label_error")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return rows.join(other, same, "left")


def codebooks_sha256(books: np.ndarray) -> str:
    """Digest of all components as decimal numbers, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector (column ``name``)."""
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "label", name)
    start = seeds(vectors, name)
    if not len(start):
        none = vectors.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.select("*", F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    folder = shared_folder(spark, "orchard-codes")
    stored = _stored_vectors(vectors, name, start.shape[1], f"{folder}/vectors")
    books = train(stored, start)
    coded = stored_table(assign(stored, books), f"{folder}/codes")
    out = _with_label_error(coded)
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def decode(codes: list[str], books: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for, in the integers' scale divided out."""
    index = np.array([list(bytes.fromhex(c)) for c in codes]).reshape(-1, len(books))
    return np.concatenate([books[p][index[:, p]] for p in range(len(books))], axis=1) / SCALE
