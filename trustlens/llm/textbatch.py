"""Vectorised text work on Arrow batches: words, 64-bit word hashes, shingles.

Used inside ``mapInArrow`` tasks. Every function looks at a bounded slice of a batch:
``slices`` cuts a batch by bytes, and word hashing cuts a long text at white space, so the
temporaries stay within a few dozen MB however long a text is (a single word longer than
a piece is one piece).
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
PIECE_BYTES = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
# the low 1 to 8 bytes of a word of eight
_LOW_BYTES = np.array([0] + [(1 << (8 * n)) - 1 for n in range(1, 9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: a bijection of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def worker_memory(key, make):
    """``make()``, made once per Python worker process and kept between its tasks (the
    functions themselves are sent anew with each task)."""
    kept = sys.modules.setdefault("_trustlens_worker_memory", types.ModuleType("_trustlens_worker_memory"))
    if key not in kept.__dict__:
        kept.__dict__[key] = make()
    return kept.__dict__[key]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offset_buffer, data_buffer = column.buffers()
    if len(column) == 0 or offset_buffer is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offset_buffer, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices of about ``limit`` text bytes (one row at least)."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; spans are sorted and do not overlap.

    A span is read in words of eight bytes (the last one filled with zeros); each word is mixed
    together with its place, the mixed words are added up, and the sum is mixed with the length. Every
    word passes the full mixer before the sum, so no pattern of the bytes cancels out (a polynomial
    modulo 2**64 gives equal hashes to Thue-Morse sequences whatever its base).
    """
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        origin = starts[at]
        to = max(int(np.searchsorted(ends, origin + PIECE_BYTES, "right")), at + 1)
        piece = np.append(data[origin : ends[to - 1]], np.zeros(8, np.uint8))
        size = (ends[at:to] - starts[at:to]).astype(np.int64)
        eights = np.maximum((size + 7) >> 3, 1)
        first = np.cumsum(eights) - eights
        place = np.arange(int(eights.sum())) - np.repeat(first, eights)
        begin = np.repeat(starts[at:to] - origin, eights) + 8 * place
        left = np.repeat(size, eights) - 8 * place
        # eight bytes from any position on
        words = np.ndarray((len(piece) - 7,), "<u8", piece.tobytes(), strides=(1,))[begin]
        words = words & _LOW_BYTES[np.minimum(left, 8)]
        mixed = mix(words + mix((place.astype(np.uint64) + np.uint64(1)) * _STEP))
        out[at:to] = mix(np.add.reduceat(mixed, first) + size.astype(np.uint64) * _LENGTH)
        at = to
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of each maximal run of bytes that are not ASCII white space."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    word = ~_SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    fresh = first[:n].copy()
    fresh[0] = True
    fresh[1:] |= ~word[:-1]
    last = first[1:].copy()
    last[-1] = True
    last[:-1] |= ~word[1:]
    starts, ends = np.flatnonzero(word & fresh), np.flatnonzero(word & last) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word ``[^\\x20\\x09-\\x0D]+`` in order; ``lower`` folds A-Z."""
    data, offsets = text_bytes(column)
    if lower:
        data = _LOWER[data]
    row, starts, ends = word_spans(data, offsets)
    return row, span_hashes(data, starts, ends)


def row_bounds(row: np.ndarray, n: int) -> np.ndarray:
    """n + 1 bounds of each row's items in a sorted ``row`` array."""
    return np.searchsorted(row, np.arange(n + 1))


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole (short) word sequence, its length included."""
    out = np.uint64(len(hashes) + 1)
    for h in hashes:
        out = mix(np.array([out * np.uint64(0xA24BAED4963EE407) + h]))[0]
    return out


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of a text's k-word shingles, sorted; a shorter text is one shingle."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < k:
        with np.errstate(over="ignore"):
            return np.array([sequence_hash(hashes)], dtype=np.uint64)
    return np.unique(windows(hashes, k))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0xA24BAED4963EE407) + hashes[i : i + n])
    return out
