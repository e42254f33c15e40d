"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds its distinct k-word shingles. Exact copies (equal sets) collapse
first. Each distinct set is embedded as ``COORDINATES`` minwise tokens. Several independent
trees then branch recursively: a node picks two (deeper down one, below the levels of ``BRANCHES`` at times
two) of the coordinates by its own hash, and its sets go to a child per token they have there, so two sets of similarity s
share each chosen branch with probability s and unlike sets part ways.

- A node of at most ``LEAF`` sets is compared exhaustively.
- A larger node compares all its sets with two pivots (a random one, and the one nearest to
  it, which in a group of edited copies tends to be their common original) and links what the
  full sets confirm; the components of all links so far are kept. A node within one component is
  done. From another, the pivots go, and every set of a pivot's component that cannot link to
  anything outside it: Jaccard distance obeys the triangle inequality, so with d(p, z) the
  least distance of a set z outside the component, a set y inside with
  d(p, y) + radius < d(p, z) has no link left to find here. The rest branches on. A group of
  thousands of near copies thus costs a few comparisons per set, not all its pairs.
- Every level removes sets and parts the unlike ones, so all nodes end up small or within one
  component, however deep. Nothing is capped or dropped.

A comparison looks at the sizes and at odd sketches first: a set's ``ODD_BITS`` bits, each the parity of the number
of items hashed to it, so that the differing bits of two sketches tell the size of the symmetric difference. Sets of
``ODD_BITS`` items and more are thinned by powers of two, by the items' hash, to half of that at least; a sketch one
level thinner goes with it, for pairs across a level. What lies within ``MARGIN`` standard deviations of the
threshold passes (3 in a million true links at the very threshold fail that). In small nodes the sets of passed pairs
then come with their full shingle sets (64-bit hashes) and are confirmed there, so that refused pairs, which may be nearly all pairs
of a group just below the threshold, never leave the task; pairs of sets above ``WHOLE`` items, which would not fit
a task by the thousand, are confirmed by a join. The number of
trees follows from ``RECALL``, the chance for a pair at the threshold in the deepest nodes: below
``BRANCHES`` such a pair has one shared child on average, and where the trees went deeper than their number
allows for, more trees follow until it does.

**Cases.** Null, empty and blank texts have no set and link with nothing (their component is
their own id). A text of fewer words than k is one shingle. Rows without an id link with
nothing, get a null component and are kept. Repeated rows are exact copies; rows that share an id
are one node whose links are those of all its texts. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustlens.llm.common import materialize, materialize_counted, release, stored_side
from trustlens.llm.components import components, contract, labels_of
from trustlens.llm.textbatch import mix, row_bounds, shingles, slices, words

COORDINATES = 64
LEAF = 4096
#: Rows that a task compares together.
TOGETHER = 8192
#: Sets of at most this size are confirmed in their small nodes, which receive them whole; larger ones by a join.
WHOLE = 2048
#: Parts, by node, in which the small nodes receive their sets one after the other: the disk holds those of a part.
PARTS = 2
#: Bits of an odd sketch.
ODD_BITS = 1024
#: Coordinates a node chooses, by level; below these one, and a second one so often that a pair at the threshold shares
#: one child on average.
BRANCHES = (2, 2, 2, 2, 1, 1, 1, 1)
RECALL = 0.9999
MARGIN = 4.5
#: Standard deviations by which the least similarity of a pair lies below the estimate. Wider, as few differing items scatter
#: to one side, and as the bound says that a pair links or that a set has no link left.
SURE = 8.0

_SKETCH_SCHEMA = "doc_id long, n_shingles long, set_a long, set_b long, sketch array<int>, odd array<long>"
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def second_branch(similarity: float) -> float:
    """How often a node below the levels of ``BRANCHES`` chooses a second coordinate."""
    return min(1.0, 1 / similarity - 1)


def trees_for(similarity: float, recall: float = RECALL, depth: int = 0) -> int:
    """Independent trees such that a pair at ``similarity`` shares a leaf with chance ``recall``
    even if its path goes to full depth: ``depth`` levels, those of ``BRANCHES`` at least."""
    survive, second = 1.0, second_branch(similarity)
    for _ in range(depth - len(BRANCHES)):
        one = similarity * survive
        survive = (1 - second) * one + second * (1 - (1 - one) ** 2)
    for branches in reversed(BRANCHES):
        survive = 1 - (1 - similarity * survive) ** branches
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survive)))


def minwise_tokens(items: np.ndarray) -> np.ndarray:
    """The least image of a set under each of the coordinates' hash functions (as int32)."""
    turn = (_SEEDS[:COORDINATES] >> np.uint64(32)).astype(np.uint32)[:, None]
    factor = (_SEEDS[COORDINATES:] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(items), 1 << 13):
        part = (items[at : at + (1 << 13)] >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, ((part[None, :] ^ turn) * factor).min(axis=1), out=least)
    return least.view(np.int32)


def odd_sketches(items: np.ndarray) -> np.ndarray:
    """The odd sketches of a set at its own level and at the next thinner one, as 64-bit words. A set of less than half the
    size at which that level starts is never compared there: zeros, which compress well."""
    h = mix(items + np.uint64(0x632BE59BD9B4E019))
    level = (len(items) // ODD_BITS).bit_length()
    out = []
    for at in (level, level + 1):
        if at > level and 2 * len(items) < ODD_BITS << level:
            out.append(np.zeros(ODD_BITS // 64, np.int64))
            continue
        kept = h[(h & np.uint64((1 << at) - 1)) == 0]
        odd = np.bincount((kept >> np.uint64(40)).astype(np.int64) % ODD_BITS, minlength=ODD_BITS) & 1
        out.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
    return np.concatenate(out)


def _document_sets(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[tuple[object, np.ndarray]]:
    for batch in batches:
        for part in slices(batch):
            row, hashes = words(part.column("text"), lower=True)
            bounds = row_bounds(row, part.num_rows)
            for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                yield doc_id, shingles(hashes[bounds[i] : bounds[i + 1]], k)


def _batched(rows: Iterable[tuple], types: dict[str, pa.DataType], weight: int, limit: int = 1 << 21):
    """Record batches of about ``limit`` units; ``weight`` is the column whose length counts."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 8 + (len(row[weight]) if row[weight] is not None else 0)
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types.values())], list(types))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types.values())], list(types))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (order-free 64-bit fingerprints of the whole set),
    sketch and odd (null for an empty set)."""

    def run(batches):
        def rows():
            for doc_id, items in _document_sets(batches, k):
                if not len(items):
                    yield doc_id, 0, 0, 0, None, None
                    continue
                yield doc_id, len(items), *fingerprints(items), minwise_tokens(items), odd_sketches(items)

        types = {
            "doc_id": pa.int64(), "n_shingles": pa.int64(), "set_a": pa.int64(), "set_b": pa.int64(),
            "sketch": pa.list_(pa.int32()), "odd": pa.list_(pa.int64()),
        }
        yield from _batched(rows(), types, weight=4)

    return docs.select("doc_id", "text").mapInArrow(run, _SKETCH_SCHEMA)


def fingerprints(items: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit fingerprints of a whole set."""
    a = np.add.reduce(mix(items)).astype(np.uint64).view(np.int64)
    b = np.bitwise_xor.reduce(mix(items ^ np.uint64(0xD6E8FEB86659FD93))).astype(np.uint64).view(np.int64)
    return int(a), int(b)


def shingle_sets(docs: DataFrame, ids: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """(id, set_a, set_b, items): the full shingle sets of the documents whose id is in ``ids`` (column id), items null
    above ``most`` of them; a task gives rows of equal id and set once. The id list is broadcast only
    if it is counted small, else joined by a shuffle."""

    def run(batches):
        def rows():
            given = set()
            for doc_id, items in _document_sets(batches, k):
                key = doc_id, *(fingerprints(items) if len(items) else (0, 0))
                if key not in given:
                    given.add(key)
                    yield *key, items.view(np.int64) if most is None or len(items) <= most else None

        types = {"id": pa.int64(), "set_a": pa.int64(), "set_b": pa.int64(), "items": pa.list_(pa.int64())}
        yield from _batched(rows(), types, weight=3)

    wanted = stored_side(ids.select(F.col("id").alias("doc_id")))
    wanted_docs = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    return wanted_docs.mapInArrow(run, "id long, set_a long, set_b long, items array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link on the full sets (an id with several texts: any of them)."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("other"), F.col("items").alias("y"))
    # the comparison is part of the join, so that only links leave it
    found = pairs.select("a", "b").join(left, "a").join(right, (F.col("b") == F.col("other")) & _similar("x", "y", percent))
    return found.select("a", "b").distinct()


def _similar(x: str, y: str, percent: int) -> Column:
    """Whether two item arrays (not empty) are similar enough."""
    both = F.size(F.array_intersect(x, y))
    return 100 * both >= percent * (F.size(x) + F.size(y) - both)


def _level(size: Column) -> Column:
    """How often a set of ``size`` items is halved for its odd sketch."""
    return F.when(size < ODD_BITS, 0).otherwise(F.floor(F.log2(F.floor(size / ODD_BITS))) + 1).cast("int")


def likeness(x: str, y: str, size_x: str, size_y: str) -> tuple[Column, Column]:
    """(least, most): the similarity of two sets by their odd sketches, ``SURE`` standard deviations down and ``MARGIN`` up.

    Of d differing items the sketches differ in about n / 2 * (1 - exp(-2 d / n)) of n bits; the variance is that of the
    bits for a given d, and of the thinning. Sets more than a level apart, or one more than twice the other, have only the bound of their sizes."""
    n, words = float(ODD_BITS), ODD_BITS // 64
    level_x, level_y = _level(F.col(size_x)), _level(F.col(size_y))
    half = lambda c, thinner: F.slice(c, F.when(thinner, words + 1).otherwise(1), words)
    differ = F.zip_with(half(x, level_x < level_y), half(y, level_y < level_x), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    z = F.least(F.aggregate(differ, F.lit(0), lambda t, v: t + v), F.lit(0.495 * n))
    level = F.greatest(level_x, level_y)
    fade = 1 - 2 * z / n  # exp(-2 d / n)
    d = -n / 2 * F.log(fade)
    spread = (n / 4 * (1 - fade * fade) - d * fade * fade) / (fade * fade) + F.when(level > 0, d).otherwise(0.0) + 1
    kept = (F.col(size_x) + F.col(size_y)) / F.pow(F.lit(2.0), level)
    off = F.sqrt(spread)
    similar = lambda gap: F.greatest(F.lit(0.0), (kept - gap) / (kept + gap))
    bound = _size_ratio(size_x, size_y)
    near = (F.abs(level_x - level_y) <= 1) & (bound >= 0.5)
    low = F.when(near, similar(d + SURE * off)).otherwise(F.lit(0.0))
    high = F.when(near, F.when(z < 0.49 * n, similar(F.greatest(F.lit(0.0), d - MARGIN * off))).otherwise(_saturated())).otherwise(bound)
    return low, F.least(high, bound)


def _saturated() -> Column:
    """Most similarity of two sets whose sketches differ in nearly half their bits: so many differing items."""
    gap = -ODD_BITS / 2 * math.log(1 - 2 * 0.45)
    return F.lit((2 * ODD_BITS - gap) / (2 * ODD_BITS + gap))


def _roots(sets: DataFrame, slots: range) -> DataFrame:
    """(node, id, sid, c, slot): the first branches of the trees. Slot j chooses coordinate j, from the first again
    after the last."""
    chosen = F.array(*(F.xxhash64(F.lit(j), F.element_at("sketch", j % COORDINATES + 1)) for j in slots))
    return sets.select("id", "sid", "c", F.posexplode(chosen).alias("slot", "node")).withColumn("slot", F.col("slot") + slots.start)


def _children(rows: DataFrame, level: int, similarity: float) -> DataFrame:
    """(node, id, sid, c, slot -1) one level down, from (node, id, sid, c, sketch)."""
    below = level >= len(BRANCHES)
    chosen = []
    for i in range(2 if below else BRANCHES[level]):
        at = F.pmod(F.xxhash64("node", F.lit(1000 + 10 * level + i)), F.lit(COORDINATES)).cast("int")
        child = F.xxhash64("node", at, F.element_at("sketch", at + 1))
        if below and i:
            draw = F.pmod(F.xxhash64("node", F.lit(1009 + 10 * level)), F.lit(1 << 20))
            child = F.when(draw < math.ceil(second_branch(similarity) * (1 << 20)), child)
        chosen.append(child)
    nodes = F.array_compact(F.array_distinct(F.array(*chosen)))
    return rows.select(F.explode(nodes).alias("node"), "id", "sid", "c", F.lit(-1).alias("slot"))


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _likeness_of(z: np.ndarray, level: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``likeness`` of pairs from their differing bits, the level compared at and the sum of their sizes."""
    n = float(ODD_BITS)
    z = np.minimum(z, 0.495 * n)
    fade = 1 - 2 * z / n
    d = -n / 2 * np.log(fade)
    spread = (n / 4 * (1 - fade * fade) - d * fade * fade) / (fade * fade) + np.where(level > 0, d, 0) + 1
    kept, off = sizes / 2.0**level, np.sqrt(spread)
    similar = lambda gap: np.maximum(0, (kept - gap) / (kept + gap))
    gap = -n / 2 * math.log(1 - 2 * 0.45)
    most = np.where(z < 0.49 * n, similar(np.maximum(0, d - MARGIN * off)), (2 * n - gap) / (2 * n + gap))
    return similar(d + SURE * off), most


class _Nodes:
    """The rows of whole nodes as arrays, sorted by node."""

    def __init__(self, table: pa.Table, similarity: float, slots: int):
        flat = lambda c, width: table.column(c).combine_chunks().flatten().to_numpy().reshape(-1, width)
        self.node, self.ids, self.c, self.size, self.slot, self.seen = (
            table.column(c).to_numpy() for c in ("node", "id", "c", "size", "slot", "seen")
        )
        self.odd, self.sketch = flat("odd", ODD_BITS // 32).view(np.uint64), flat("sketch", slots)
        self.level = np.array([(int(x) // ODD_BITS).bit_length() for x in self.size])
        self.similarity, self.slots = similarity, slots

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the pairs of rows may link, the most similarity of those): sizes and odd sketches allow it, and
        the pair does not meet in an earlier small first branch, which compares it."""
        small, large = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        at = np.flatnonzero((self.ids[i] != self.ids[j]) & (small >= self.similarity * large))
        i, j = i[at], j[at]
        level, words = np.maximum(self.level[i], self.level[j]), ODD_BITS // 64
        z = np.zeros(len(i), np.int64)
        for w in range(words):
            x = self.odd[i, np.where(self.level[i] < level, w + words, w)]
            y = self.odd[j, np.where(self.level[j] < level, w + words, w)]
            z += np.bitwise_count(x ^ y)
        bound = np.minimum(self.size[i], self.size[j]) / np.maximum(np.maximum(self.size[i], self.size[j]), 1)
        _, most = _likeness_of(z, level, self.size[i] + self.size[j])
        far = (np.abs(self.level[i] - self.level[j]) > 1) | (bound < 0.5)
        most = np.where(far, bound, np.minimum(most, bound))
        ok = most >= self.similarity
        for k in range(self.slots):
            ok &= ~((self.slot[i] > k) & (self.seen[i] >> k & 1 > 0) & (self.sketch[i, k] == self.sketch[j, k]))
        return at[ok], most[ok]


def _marked(rows: _Nodes) -> np.ndarray:
    """Whether a row may link to a row of another component in its node: row i meets row i + 1 of its node, then i + 2
    and so on, all nodes at once; pairs of two marked rows are left out."""
    marked = np.zeros(len(rows.node), dtype=bool)
    left = np.arange(len(rows.node))
    for step in range(1, len(rows.node)):
        left = left[left + step < len(rows.node)]
        left = left[rows.node[left] == rows.node[left + step]]
        if not len(left):
            break
        i = left[(rows.c[left] != rows.c[left + step]) & ~(marked[left] & marked[left + step])]
        near, _ = rows.near(i, i + step)
        marked[i[near]] = marked[i[near] + step] = True
    return marked


def _linked(rows: _Nodes, items: pa.Array, percent: int) -> Iterator[tuple[int, int, float, bool]]:
    """(a, b, most similarity, whether the full sets link) of pairs in the nodes that may link: of sets with items the links
    alone, one for two parts that links join in the node; pairs of sets without items unconfirmed."""
    whole = np.asarray(items.is_valid())
    bounds = np.concatenate([[0], np.cumsum(np.where(whole, rows.size, 0))])
    values, codes = np.unique(items.drop_null().flatten().to_numpy(), return_inverse=True)
    inside = np.zeros(len(values), dtype=bool)
    starts = np.flatnonzero(np.concatenate([[True], rows.node[1:] != rows.node[:-1]]))
    for low, high in zip(starts, [*starts[1:], len(rows.node)]):
        _, part = np.unique(rows.c[low:high], return_inverse=True)
        for i in range(low, high - 1):
            j = np.arange(i + 1, high)[part[i + 1 - low :] != part[i - low]]
            near, most = rows.near(np.full(len(j), i), j)
            j = j[near]
            known = whole[j] & whole[i]
            for other, like in zip(j[~known], most[~known]):
                yield min(rows.ids[i], rows.ids[other]), max(rows.ids[i], rows.ids[other]), like, False
            j, most = j[known], most[known]
            if not len(j):
                continue
            sizes = rows.size[j]
            ends = np.cumsum(sizes)
            at = np.repeat(bounds[j] - (ends - sizes), sizes) + np.arange(ends[-1])
            own = codes[bounds[i] : bounds[i + 1]]
            inside[own] = True
            both = np.add.reduceat(inside[codes[at]].astype(np.int64), ends - sizes)
            inside[own] = False
            links = 100 * both >= percent * (rows.size[i] + sizes - both)
            parts, first = np.unique(part[j[links] - low], return_index=True)
            for x in first:
                other = j[links][x]
                yield min(rows.ids[i], rows.ids[other]), max(rows.ids[i], rows.ids[other]), most[links][x], True
            part[np.isin(part, parts)] = part[i - low]


def _by_node(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on tables of whole nodes of about TOGETHER rows, sorted by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < TOGETHER:
                continue
            table = pa.Table.from_batches(held)
            node = table.column("node").to_numpy()
            cut = int(np.searchsorted(node, node[-1], "left"))  # the last node may go on in the next batch
            if cut:
                yield work(table.slice(0, cut))
            held, n = table.slice(cut).to_batches(), len(node) - cut
        if n:
            yield work(pa.Table.from_batches(held))

    # ascending by node, as whole nodes are cut off by their number
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, schema)


_ROW = ["node", "id", "sid", "c", "slot", "seen", "size", "sketch", "odd"]
_ROW_SCHEMA = "node long, id long, sid long, c long, slot int, seen long, size long, sketch array<int>, odd array<long>"


def _open_sets(leaf: DataFrame, sets: DataFrame, percent: int, slots: int) -> DataFrame:
    """The rows of small nodes, with what a comparison looks at, whose set may link to another component in its node. Every set goes to its node once; a
    node of at most ``LEAF`` sets is one array of a task. ``seen`` has a bit for each slot (of the first
    COORDINATES - 1) in which the set's own branch is small."""
    one = F.lit(1).cast("long")
    bit = F.when(F.col("slot").between(0, slots - 1), F.call_function("shiftleft", one, F.col("slot"))).otherwise(0)
    rows = leaf.withColumn("seen", F.bit_or(bit).over(Window.partitionBy("id", "sid")))

    def mark(table: pa.Table) -> pa.RecordBatch:
        kept = table.select(_ROW).filter(pa.array(_marked(_Nodes(table, percent / 100, slots))))
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in kept.columns], _ROW)

    rows = rows.join(sets.withColumn("sketch", F.slice("sketch", 1, slots)), ["id", "sid"]).select(*_ROW)
    return _by_node(rows, mark, _ROW_SCHEMA)


def _node_links(rows: DataFrame, docs: DataFrame, k: int, percent: int, slots: int) -> DataFrame:
    """(a, b, like, linked): links within the nodes of ``rows``, confirmed there on the full sets, which go to each
    node once. A group of thousands of copies thus gives a link a set, and the refused pairs never leave
    their node. Pairs with a set above ``WHOLE`` items come unconfirmed."""
    items = shingle_sets(docs, rows.select("id").distinct(), k, WHOLE)
    full = items.select("id", F.xxhash64("set_a", "set_b").alias("sid"), "items")  # read once, by the join

    def link(table: pa.Table) -> pa.RecordBatch:
        found = _linked(_Nodes(table, percent / 100, slots), table.column("items").combine_chunks(), percent)
        columns = list(zip(*found)) or [()] * 4
        types = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["a", "b", "like", "linked"])

    rows = rows.join(full, ["id", "sid"]).select(*_ROW, "items")
    return _by_node(rows, link, "a long, b long, like double, linked boolean")


def _size_ratio(x: str, y: str) -> Column:
    """Upper bound of two sets' similarity from their sizes."""
    return F.least(x, y) / F.greatest(x, y)


def _label(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` with the component found so far of each id (its own id if none)."""
    if labels is None:
        return rows.withColumn("c", F.col("id"))
    return rows.join(labels, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def _open_nodes(rows: DataFrame) -> tuple[DataFrame, int]:
    """(node, id, sid, slot, c, n) of the nodes that still hold several components, and how many rows lie in nodes
    above the leaf size."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))
    nodes = rows.join(sizes.where("low < high").select("node", "n"), "node")
    stored, (big,) = materialize_counted(nodes, F.count_if(F.col("n") > LEAF))
    return stored, big


def _with_pivots(big: DataFrame) -> DataFrame:
    """Rows of large nodes (node, id, c, size, sketch, odd) with two pivots of their node and the least and most similarity
    to each: p random, q the nearest to p (ties by hash)."""
    pivot, own = F.struct("id", "c", "size", "odd"), ["node", "id", "sid", "c", "size", "sketch", "odd"]
    first = big.groupBy("node").agg(F.min_by(pivot, F.xxhash64("id", "node")).alias("p"))
    low, high = likeness("odd", "p.odd", "size", "p.size")
    rows = big.join(first, "node").select(*own, F.col("p.id").alias("p"), F.col("p.c").alias("p_c"), low.alias("p_low"), high.alias("p_most"))
    rows = materialize(rows)
    nearest = F.struct(F.col("p_low") + F.col("p_most"), F.xxhash64("id"))
    second = rows.where("id != p").groupBy("node").agg(F.max_by(pivot, nearest).alias("q"))
    low, high = likeness("odd", "q.odd", "size", "q.size")
    of_q = [F.col("q.id").alias("q"), F.col("q.c").alias("q_c"), low.alias("q_low"), high.alias("q_most")]
    kept = [c for c in own if c != "odd"]
    return materialize(rows.join(second, "node").select(*kept, "p", "p_c", "p_low", "p_most", *of_q))


def _unsettled(rows: DataFrame, labels: DataFrame | None, radius: float) -> DataFrame:
    """(node, id, sid, c, sketch) of the sets that may still link to another component in their node."""
    now = _label(rows.drop("c"), labels)
    for x in "pq":
        if labels is None:
            now = now.withColumn(f"{x}_now", F.col(x))
            continue
        of_pivot = labels.select(F.col("id").alias(x), F.col("component").alias(f"{x}_now"))
        now = now.join(of_pivot, x, "left").withColumn(f"{x}_now", F.coalesce(f"{x}_now", x))
    outside = now.groupBy("node").agg(
        *(F.max(F.when(F.col("c") != F.col(f"{x}_now"), F.col(f"{x}_most"))).alias(f"{x}_out") for x in "pq")
    )
    settled = F.col("id").isin(F.col("p"), F.col("q"))
    for x in "pq":
        # upper bound of d(pivot, inside) + radius < lower bound of d(pivot, any outside)
        apart = (1 - F.col(f"{x}_low")) + radius < 1 - F.col(f"{x}_out")
        settled = settled | ((F.col("c") == F.col(f"{x}_now")) & (F.col(f"{x}_out").isNull() | apart))
    return now.join(outside, "node").where(~settled).select("node", "id", "sid", "c", "sketch")


def links(sets: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (u, v) over distinct sets (id, sid, size, sketch, odd) with the same components as all links of at least
    ``percent`` similarity."""
    s = percent / 100
    edges = labels = None
    leaves, trees, depth = [], 0, len(BRANCHES)
    while trees < (wanted := trees_for(s, depth=depth)):
        rows, level = _roots(_label(sets, labels), range(trees * BRANCHES[0], wanted * BRANCHES[0])), 1
        trees = wanted
        while True:
            nodes, n_big = _open_nodes(rows)
            leaves.append(nodes.where(F.col("n") <= LEAF).select("node", "id", "sid", "c", "slot"))
            if not n_big:
                break
            rows = _with_pivots(nodes.where(F.col("n") > LEAF).select("node", "id", "sid", "c").join(sets, ["id", "sid"]))
            near = _union([
                rows.where((F.col("c") != F.col(f"{x}_c")) & (F.col(f"{x}_most") >= s)).select(*_pairs(F.col("id"), F.col(x)))
                for x in "pq"
            ])
            near, (n_near,) = materialize_counted(near.distinct(), F.count(F.lit(1)))
            if n_near:
                found = confirm(near, shingle_sets(docs, _ends(near), k), percent)
                edges, labels = _with_links(edges, found)
            rest = materialize(_unsettled(rows, labels, 1 - s))
            rows = _children(rest, level, s)
            level += 1
            release(docs.sparkSession)
        depth = max(depth, level)
    slots = min(trees * BRANCHES[0], COORDINATES - 1)
    marked = materialize(_open_sets(_union(leaves), sets, percent, slots))
    release(docs.sparkSession)
    parts, n_far = [], 0
    for part in range(PARTS):
        rows = _label(marked.where(F.pmod("node", F.lit(PARTS)) == part).drop("c"), labels)
        found, (n,) = materialize_counted(_node_links(rows, docs, k, percent, slots), F.count_if(~F.col("linked")))
        parts.append(found)
        n_far += n
        release(docs.sparkSession)
    found = _union(parts)
    edges, _ = _with_links(edges, found.where("linked"))
    release(docs.sparkSession)
    if n_far:
        far = found.where("NOT linked").groupBy("a", "b").agg(F.max("like").alias("like"))
        edges = _far_links(far, edges, docs, k, percent)
    return edges


def _far_links(pairs: DataFrame, edges: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``edges`` with the links among pairs (a, b, like) of large sets, confirmed by a join with the sets."""
    pairs = materialize(_apart(pairs, components(edges)))
    full = materialize(shingle_sets(docs, _ends(pairs), k))
    # each set with its likest candidate; then only the pairs still in different components
    both = pairs.select("a", "b", "like").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "like"))
    first = both.groupBy("a").agg(F.max_by("b", F.struct("like", F.xxhash64("b"))).alias("b"))
    first = materialize(first.select(*_pairs(F.col("a"), F.col("b"))).distinct())
    edges, _ = _with_links(edges, confirm(first, full, percent))
    release(docs.sparkSession)
    left = _apart(pairs.join(first, ["a", "b"], "left_anti"), components(edges))
    left, (n_left,) = materialize_counted(left, F.count(F.lit(1)))
    if n_left:
        asked = full.join(stored_side(_ends(left)), "id", "left_semi")
        edges, _ = _with_links(edges, confirm(left, asked, percent))
        release(docs.sparkSession)
    return edges


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _with_links(edges: DataFrame | None, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges (u, v) with the links found, one contraction on, and the labels they give so far."""
    new = materialize(found.select(F.col("a").alias("u"), F.col("b").alias("v")))  # a contraction reads it several times
    edges = materialize(contract(new if edges is None else edges.unionAll(new)))
    return edges, labels_of(edges)


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs (a, b) whose ends are not known to be in one component."""
    if labels is None:
        return pairs
    for x in "ab":
        pairs = pairs.join(labels.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}")), x, "left")
    return pairs.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).drop("c_a", "c_b")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links), kept."""
    docs = docs.select("doc_id", "text")
    members = materialize(sketches(docs, k))
    counts = materialize(members.select("doc_id", "n_shingles"))
    shape = ["n_shingles", "set_a", "set_b"]
    linkable = members.where("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = linkable.groupBy(*shape).agg(F.min("doc_id").alias("id"))
    placed = materialize(linkable.select("doc_id", *shape).join(groups, shape).select("doc_id", "id").distinct())
    representatives = linkable.join(groups.withColumnRenamed("id", "doc_id"), ["doc_id", *shape], "left_semi")
    representatives = representatives.select(F.col("doc_id").alias("id"), *shape, "sketch", "odd")
    sets = materialize(representatives.dropDuplicates(["id", *shape]))
    del members, linkable, groups, representatives  # the stored sketches are those of ``sets`` from here on
    release(docs.sparkSession)
    # an id with several texts joins their groups
    same = placed.groupBy("doc_id").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    same = placed.join(same, "doc_id").select(F.col("least").alias("a"), F.col("id").alias("b"))
    sets = sets.select("id", F.xxhash64("set_a", "set_b").alias("sid"), F.col("n_shingles").alias("size"), "sketch", "odd")
    edges = links(sets, docs, k, percent)
    labels = components(edges.unionAll(same.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    of_id = (
        placed.groupBy("doc_id").agg(F.min("id").alias("id"))
        .join(labels, "id", "left")
        .select("doc_id", F.coalesce("component", "id").alias("found"))
    )
    out = counts.join(of_id, "doc_id", "left")
    component = F.coalesce("found", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )
