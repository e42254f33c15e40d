"""Hashes of words, lines and chunks on sequences that a polynomial modulo 2**64 cannot tell apart."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trustlens.llm import bitpack, chosen_path, kneser_ney, line_variants, textbatch
from llm_fixtures import make_docs, shipped  # noqa: F401


def thue_morse(n: int, one, other) -> list:
    """The sequence and its opposite."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return [[(one, other)[b] for b in bits], [(other, one)[b] for b in bits]]


A, B = ("".join(x) for x in thue_morse(2048, "a", "b"))


def _hashes(words):
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return textbatch.span_hashes(data, np.append(0, ends[:-1]), ends)


def test_words_apart():
    rng = random.Random(5)
    words = {A, B, "x", "x\0", "\0x", "\0", "\0\0", "é", "abcdefgh", "abcdefghi", "abcdefgh" * 2, "bcdefgha" * 2}
    words |= {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))) for _ in range(2000)}
    words = sorted(words)
    got = _hashes(words)
    assert len(set(got.tolist())) == len(words)
    # a word's hash depends on its bytes alone, not on its place in a text or batch
    order = list(range(len(words)))
    rng.shuffle(order)
    assert (_hashes([words[i] for i in order]) == got[order]).all()


def test_pieces_do_not_matter(monkeypatch):
    words = ["w" * n for n in range(1, 60)]
    want = _hashes(words)
    monkeypatch.setattr(textbatch, "PIECE_BYTES", 50)
    assert (_hashes(words) == want).all()


@given(st.integers(0, line_variants._PRIME - 1), st.integers(0, line_variants._PRIME - 1), st.integers(0, 2**64 - 1))
def test_modular_arithmetic(a, b, x):
    p, one = line_variants._PRIME, lambda v: np.array([v], dtype=np.uint64)
    assert int(line_variants._times(one(a), one(b))[0]) == a * b % p
    assert int(line_variants._minus(one(a), one(b))[0]) == (a - b) % p
    assert int(line_variants._fold(one(x))[0]) == x % p
    n = [a, b] * 20
    assert line_variants._running(np.array(n, dtype=np.uint64)).tolist() == [sum(n[: i + 1]) % p for i in range(40)]
    assert line_variants._powers(a, 9).tolist() == [pow(a, i, p) for i in range(9)]


def test_line_keys_depend_on_their_words():
    """Keys of variants equal the keys of the lines they spell."""
    words = "red blue red red green blue one two three".split()
    shorter = [" ".join(words[:i] + words[i + 1 :]) for i in range(len(words))]
    lines = line_variants.Lines(pa.array(["\n".join([" ".join(words), *shorter])]))
    _, _, rest = lines.variants(np.array([0]))
    assert rest.tolist() == lines.keys()[1:].tolist()
    red, blue = (" ".join(x) for x in thue_morse(2048, "red", "blue"))
    keys = line_variants.Lines(pa.array([red, blue, A, B])).keys()
    assert len(set(keys.tolist())) == 4


def test_line_dedup_keeps_unlike_lines(make_docs):
    red, blue = (" ".join(x) for x in thue_morse(1024, "red", "blue"))
    got = {r["doc_id"]: r for r in line_variants.dedup_lines(make_docs([(1, red), (2, blue), (3, A), (4, B), (5, B)])).collect()}
    assert [got[i]["text"] for i in (1, 2, 3, 4, 5)] == [red, blue, A, B, ""]


def test_token_ids_equal_the_tokenizers():
    encoder = bitpack.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [A, B, f"{A} {B} {A}", None, ""]
    ids, counts = encoder.encode(pa.array(texts))
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]


def test_base_rules_count_only_equal_words():
    text = f"{A} x y {B} x y\n{A} z\n{B} z\n{A} z"
    got = {k: v.tolist() for k, v in kneser_ney.base_rules(pa.array([text])).items()}
    assert got["n_dup_lines"] == [1] and got["n_repeat_words"] == [0]


def test_near_duplicates_of_long_words(make_docs):
    rows = [(1, f"{A} x y"), (2, f"{B} x y"), (3, f"{A} x y")]
    found = chosen_path.near_duplicates(make_docs(rows), k=3, percent=85)
    got = {r["doc_id"]: r["component_id"] for r in found.select("doc_id", F.col("component_id")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
