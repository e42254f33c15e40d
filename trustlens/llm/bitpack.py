"""Token ids in fixed-width bit-packed blocks.

**Format.** Documents are sorted by ``doc_id`` (null first, ties by text) and dealt by range
into shards. A shard is a Parquet part written by Spark's committer (atomic and safe under
task retries and lost executors, on any Hadoop file system). Each of its rows is one block:

- ``shard`` int, ``block`` long: place in the order; ids ascend over (shard, block),
- ``n_docs`` int, ``n_ids`` long, ``bits`` int: the width, the minimum for the vocabulary,
- ``doc_ids`` array<long>, ``ends`` array<long>: each document's end within the block,
- ``payload`` binary: the ids, ``bits`` bits each, least significant bit first.

A block closes after the document that brings it to ``block_ids`` ids, so a document never
spans blocks. Id number i lies at bit ``i * bits`` of the payload: ``unpack`` reads any id
range with numpy, without touching the rest. ``starts`` gives every block's global offset
from the block directory alone (the payload column is pruned).

**Cases.** Null and empty texts hold the end id alone. Repeated rows and equal ``doc_id``
values stay separate documents, in text order. Other columns are ignored. An empty table
gives an empty file set. Very long texts are tokenised in pieces cut where the pre-tokeniser
always splits, so memory follows the piece, and the ids equal those of the whole text.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustlens.llm.textbatch import slices, span_hashes, text_bytes, worker_memory

BLOCK_SCHEMA = (
    "shard int, block long, n_docs int, n_ids long, bits int, doc_ids array<long>, ends array<long>, payload binary"
)
BLOCK_IDS = 1 << 16
#: Chunks whose ids a task remembers; a full memory is emptied. Affects time only.
CACHE_CHUNKS = 1_000_000
SLICE_BYTES = 1 << 20

# 1 ASCII white space, 2 ASCII letter, 3 ASCII punctuation, 4 ASCII digit, 0 all else
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[0x20, *range(0x09, 0x0E)]] = 1
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 2
_KIND[0x30:0x3A] = 4


def width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a little-endian bit string of ``bits`` bits each; an id that needs more is an error."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = bytearray()
    for at in range(0, len(ids), 1 << 18):  # a multiple of 8 ids: pieces end on byte bounds
        part = ids[at : at + (1 << 18)].astype(np.uint32)
        planes = (part[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
        out += np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()
    return bytes(out)


def unpack(payload: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """Ids ``first .. first + n`` of a payload; reads only their bytes."""
    if n <= 0:
        return np.zeros(0, np.uint32)
    if bits in (8, 16, 32):
        size = bits // 8
        return np.frombuffer(payload, f"<u{size}", n, first * size).astype(np.uint32)
    low, high = first * bits // 8, -(-(first + n) * bits // 8)
    planes = np.unpackbits(np.frombuffer(payload, np.uint8, high - low, low), bitorder="little")
    skip = first * bits - low * 8
    planes = planes[skip : skip + n * bits].reshape(n, bits).astype(np.uint32)
    return (planes << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def cut_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which a byte-level pre-tokeniser always splits: document starts, ASCII
    white space after a character that is not white space of any kind, and ASCII punctuation
    after a letter."""
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    if n:
        kind = _KIND[data]
        before, two = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        before[1:], two[2:] = data[:-1], data[:-2]
        accented = (two == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        seen = _KIND[before]
        cut[:n] = (kind == 1) & (accented | (seen >= 2)) | (kind == 3) & (accented | (seen == 2))
    cut[offsets] = True
    cut[n] = False
    return np.flatnonzero(cut)


class ChunkEncoder:
    """Ids of texts from the ids of their chunks (a word with the white space before it);
    only chunks not seen before go to the tokenizer."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        # one thread: Spark runs a worker per core (read by the library on its first batch)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), cache_chunks
        # strings the library takes out of a text before it pre-tokenises
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.keys, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.count, self.ids = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, chunks: list[str]) -> None:
        """Remember the ids of new chunks; ``keys`` is sorted and disjoint from the known keys."""
        counts, flats = [], []
        for at in range(0, len(chunks), 1024):
            batch = self.tokenizer.encode_batch_fast(chunks[at : at + 1024], add_special_tokens=False)
            lists = [x.ids for x in batch]
            counts.append(np.fromiter(map(len, lists), np.int32, len(lists)))
            flats.append(np.fromiter(chain.from_iterable(lists), np.uint32))
        count = np.concatenate(counts)
        first = len(self.ids) + np.cumsum(count, dtype=np.int64) - count
        at = np.searchsorted(self.keys, keys)
        self.ids = np.concatenate([self.ids, *flats])
        self.keys, self.first = np.insert(self.keys, at, keys), np.insert(self.first, at, first)
        self.count = np.insert(self.count, at, count)

    def encode_whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, without the memory of chunks."""
        lists = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        return np.fromiter(chain.from_iterable(lists), np.uint32), np.array([len(x) for x in lists], np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each row)."""
        data, offsets = text_bytes(column)
        rows = len(offsets) - 1
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            return self.encode_whole([raw[a:b].decode("utf-8") for a, b in zip(offsets, offsets[1:])])
        starts = cut_points(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        ends = np.append(starts[1:], len(data))
        row = np.searchsorted(offsets, starts, "right") - 1
        keys, where, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.limit:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            self.learn(keys[new], [raw[starts[i] : ends[i]].decode("utf-8") for i in where[new]])
            at = np.searchsorted(self.keys, keys)
        first, count = self.first[at][back], self.count[at][back]
        total = int(count.sum())
        begin = np.cumsum(count) - count
        ids = self.ids[np.repeat(first - begin, count) + np.arange(total)]
        return ids, np.bincount(row, weights=count, minlength=rows).astype(np.int64)


def _blocks(tokenizer_path: str, vocabulary: int, end_id: int, block_ids: int):
    bits = width(max(vocabulary, end_id + 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = worker_memory(("chunk encoder", tokenizer_path), lambda: ChunkEncoder(tokenizer_path))
        block, doc_ids, ends, parts, size = 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "block": pa.array([block], pa.int64()),
                    "n_docs": pa.array([len(doc_ids)], pa.int32()),
                    "n_ids": pa.array([size], pa.int64()),
                    "bits": pa.array([bits], pa.int32()),
                    "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                    "ends": pa.array([ends], pa.list_(pa.int64())),
                    "payload": pa.array([pack(np.concatenate(parts), bits)], pa.binary()),
                }
            )

        end = np.array([end_id], np.uint32)
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                ids, counts = encoder.encode(part.column("text"))
                at = 0
                for doc_id, n in zip(part.column("doc_id").to_pylist(), counts.tolist()):
                    parts += [ids[at : at + n], end]
                    at, size = at + n, size + n + 1
                    doc_ids.append(doc_id)
                    ends.append(size)
                    if size >= block_ids:
                        yield close()
                        block, doc_ids, ends, parts, size = block + 1, [], [], [], 0
                # what is carried over must not keep this slice's arrays alive
                parts = [np.concatenate(parts)] if parts else []
        if doc_ids:
            yield close()

    return run


def write_blocks(
    docs: DataFrame, path: str, tokenizer_path: str, vocabulary: int, end_id: int, block_ids: int = BLOCK_IDS
) -> None:
    """Tokenise ``docs`` (doc_id, text) and write the bit-packed file set to ``path``."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_blocks(tokenizer_path, vocabulary, end_id, block_ids), BLOCK_SCHEMA).write.mode(
        "overwrite"
    ).option("compression", "zstd").parquet(path)


def starts(blocks: DataFrame) -> DataFrame:
    """(shard, block, start): ids before each block. The running sum over shards is over one
    row per shard; within a shard it is over that shard's block rows."""
    size = blocks.select("shard", "block", "n_ids")
    per_shard = size.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = per_shard.select(
        "shard",
        (F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids")).alias(
            "base"
        ),
    )
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return (
        size.withColumn("inside", F.sum("n_ids").over(inside) - F.col("n_ids"))
        .join(before, "shard")
        .select("shard", "block", (F.col("base") + F.col("inside")).alias("start"))
    )


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ends = np.array(row["ends"], np.int64)
            ids = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
            begins = np.append(0, ends[:-1])
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([row["shard"]] * len(ends), pa.int32()),
                    "block": pa.array([row["block"]] * len(ends), pa.int64()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "first": pa.array(begins, pa.int64()),
                    "n_tokens": pa.array(ends - begins, pa.int64()),
                    "ids_crc32": pa.array(
                        [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends)], pa.int64()
                    ),
                }
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, read back from the files: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit)."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    found = blocks.mapInArrow(
        _documents, "shard int, block long, doc_id long, first long, n_tokens long, ids_crc32 long"
    )
    return found.join(starts(blocks), ["shard", "block"]).select(
        "doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_ids(spark: SparkSession, path: str, start: int, n: int) -> np.ndarray:
    """Random access: ids ``start .. start + n`` of the whole set, from the blocks that hold them."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    hit = starts(blocks).join(blocks.select("shard", "block", "n_ids", "bits", "payload"), ["shard", "block"])
    hit = hit.where((F.col("start") < start + n) & (F.col("start") + F.col("n_ids") > start)).orderBy("start")
    out = []
    for row in hit.toLocalIterator():
        low, high = max(start - row["start"], 0), min(start + n - row["start"], row["n_ids"])
        out.append(unpack(row["payload"], row["bits"], low, high - low))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
