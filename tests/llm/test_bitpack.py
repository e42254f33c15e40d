from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from trustlens.llm import bitpack
from trustlens.llm.queries import END_ID, TOKENIZER, VOCABULARY
from llm_fixtures import make_docs, shipped  # noqa: F401

ODD = [
    "a  b\n\n c\t\td  ", "x  y  z　  q", "  lead", "<|endoftext|> hi<|endoftext|>", "é àà ñ  x\x1f y\x85 z",
    "it's don't I'LL  we've\r\n\r\nx", "", "日本 語 テスト", "a​ b 1 2  3", "x\x0b\x0cy", " ", "né, ×, ÷; é…’, a1,b-2", "\x00 z",
]


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_pack_round_trip_and_random_access(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 300_001, dtype=np.uint64).astype(np.uint32)
    packed = bitpack.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    for first, n in ((0, len(ids)), (777, 501), (262_143, 9), (5, 0), (len(ids) - 1, 1)):
        assert (bitpack.unpack(packed, bits, first, n) == ids[first : first + n]).all()


def test_width_is_the_minimum():
    assert [bitpack.width(v) for v in (1, 2, 3, 256, 257, 50_257, 65_537)] == [1, 1, 2, 8, 9, 16, 17]


def test_chunks_give_the_ids_of_the_whole_text(reference):
    encoder = bitpack.ChunkEncoder(TOKENIZER, cache_chunks=10)
    for texts in (ODD, ODD[::-1], [None, "plain words, again and again", "plain words"], [x for x in ODD if "<|" not in x]):
        ids, counts = encoder.encode(pa.array(texts, pa.string()))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [reference(t) for t in texts]


def test_files_read_back(spark, make_docs, tmp_path, reference):
    rows = [(i * 7 % 101, t) for i, t in enumerate(ODD * 4)] + [(None, "no id"), (3, None), (3, "again"), (3, "again")]
    docs = make_docs(rows, extra=["shard", "block", "first"])
    path = str(tmp_path / "tokens")
    bitpack.write_blocks(docs, path, TOKENIZER, VOCABULARY, END_ID, block_ids=40)
    got = sorted((tuple(r) for r in bitpack.read_documents(spark, path).collect()), key=lambda r: r[1])
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at, want, everything = 0, [], []
    for doc_id, text in ordered:
        ids = [*reference(text), END_ID]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        everything += ids
    assert got == want
    for start, n in ((0, 5), (37, 90), (at - 3, 3), (at, 4)):
        assert bitpack.read_ids(spark, path, start, n).tolist() == everything[start : start + n]
    blocks = spark.read.parquet(path)
    assert blocks.where("bits <> 16").count() == 0 and blocks.count() > 3


def test_empty_table(spark, make_docs, tmp_path):
    path = str(tmp_path / "none")
    bitpack.write_blocks(make_docs([]), path, TOKENIZER, VOCABULARY, END_ID)
    assert bitpack.read_documents(spark, path).count() == 0 and len(bitpack.read_ids(spark, path, 0, 5)) == 0


def test_a_long_text_among_short_ones(spark, make_docs, tmp_path, reference):
    long = " ".join(f"word{i % 977}" for i in range(400_000))
    path = str(tmp_path / "long")
    bitpack.write_blocks(make_docs([(1, "a b"), (2, long), (3, "c")]), path, TOKENIZER, VOCABULARY, END_ID)
    got = {r["doc_id"]: r for r in bitpack.read_documents(spark, path).collect()}
    assert got[2]["n_tokens"] == len(reference(long)) + 1 and got[3]["start"] == got[2]["start"] + got[2]["n_tokens"]


def test_an_id_that_does_not_fit_is_an_error():
    for bits in (8, 11, 16):
        assert bitpack.unpack(bitpack.pack(np.array([(1 << bits) - 1]), bits), bits, 0, 1).tolist() == [(1 << bits) - 1]
        with pytest.raises(ValueError, match="does not fit"):
            bitpack.pack(np.array([1, 1 << bits]), bits)
