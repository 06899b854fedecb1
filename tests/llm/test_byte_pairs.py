"""Byte-level pairs against the library that the rank file is made for."""

import base64
import functools
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cliploom.llm import byte_pairs
from cliploom.llm.vocab import public_file

FILE = public_file("byte_bpe_multi_50k.tiktoken")
ODD = [
    "", " ", "\n\n", "a  b\n\n c ", "it's we'll I'D 'RE ''s 's't '' 're'", " 's", "\n's", "\t 'st", "x'sy z'rex", "!'s '!'ll", "'", "'l", "'r",
    "12٣ 3a b4", "a\x1cb \x1d\x1e", "a​b 　x\u0085y\xa0z", "é é 日本語 \U0001f389", "Ⅷ ½x", "ßß\r\n \r\n", "<|endoftext|>",
    "  trailing  ", "a" * 3000, " " * 700 + "x", "'" * 501, "\n" * 300, "?!" * 200]
ALPHABET = "ab'strevlmd  \n\t1٣é中!?.-_’ 　\x1c\U0001f600½"


@functools.cache
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(texts):
    ids, offsets, counts = byte_pairs.vocabulary(FILE).encode(texts)
    at = np.cumsum(counts) - counts
    return [ids[a : a + n].tolist() for a, n in zip(at, counts)], [offsets[a : a + n].tolist() for a, n in zip(at, counts)]


def test_equals_the_library():
    rng = random.Random(7)
    texts = ODD + ["".join(rng.choice(ODD[:19] + list(ALPHABET)) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for _ in range(2):  # the second time from the cache
        assert ids_of(texts)[0] == [library().encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(ALPHABET, max_size=60), st.text(st.characters(codec="utf-8"), max_size=40)), max_size=8))
def test_any_texts(texts):
    assert ids_of(texts)[0] == [library().encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("row", [1, 2, 7, 64])
def test_scan_is_associative(monkeypatch, row):
    """Rows of any length give the borders of one pass from left to right."""
    monkeypatch.setattr(byte_pairs, "ROW", row)
    kinds = np.random.default_rng(row).integers(0, 8, 500).astype(np.uint8)
    kinds[[0, 100, 101]] += 8
    state, want = byte_pairs.FRESH, []
    for k in kinds.tolist():
        state, begins = byte_pairs._step(byte_pairs.FRESH if k >= 8 else state, k % 8)
        want.append(begins or k >= 8)
    assert byte_pairs.match_starts(kinds).tolist() == want


def test_classes_of_the_neighbours():
    points = np.frombuffer("a  b'll 's\nx ".encode("utf-32-le"), "<u4")
    first = np.zeros(len(points), bool)
    first[0] = True
    k = byte_pairs
    want = [k.LETTER + 8, k.BLANK, k.LAST_SPACE, k.LETTER, k.LONG, k.LETTER, k.LETTER, k.LAST_SPACE, k.SHORT, k.LETTER, k.LAST_BLANK,
            k.LETTER, k.BLANK]
    assert k.kinds_of(points, first).tolist() == want


def test_full_cache(monkeypatch):
    monkeypatch.setattr(byte_pairs, "CACHE_PIECES", 3)
    for t in ODD:
        assert ids_of([t])[0] == [library().encode_ordinary(t)]


def test_operator_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "no id"), (5, "again"), (5, "again"), (101, "long text, " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS ids", "1 AS n_tokens", "2 AS offsets")
    out = byte_pairs.decode(byte_pairs.encode(docs)).collect()
    assert len(out) == len(rows)
    key = lambda r: (-1 if r[0] is None else r[0], r[1] or "")
    got = sorted(((r["doc_id"], bytes(r["decoded"]).decode(), bytes(r["ids"]), bytes(r["offsets"]), r["n_tokens"]) for r in out), key=key)
    for (i, text), (doc_id, decoded, ids, offsets, n) in zip(sorted(rows, key=key), got, strict=True):
        want = library().encode_ordinary(text or "")
        assert doc_id == i and decoded == (text or "") and n == len(want)
        assert np.frombuffer(ids, "<u4").tolist() == want
        lengths = [len(library().decode_single_token_bytes(t)) for t in want]
        assert np.frombuffer(offsets, "<u4").tolist() == (np.cumsum(lengths) - lengths).astype(int).tolist()


def test_decode_keeps_columns_and_refuses_wrong_offsets(spark):
    df = spark.createDataFrame(
        [(1, bytearray(np.array([72, 73], "<u4").tobytes()), bytearray(np.array([0, 1], "<u4").tobytes()), "kept", "old"),
         (2, None, None, None, None)], "doc_id long, ids binary, offsets binary, extra string, decoded string")
    if len({len(library().decode_single_token_bytes(t)) for t in (72, 73)}) == 1:
        out = {r["doc_id"]: r for r in byte_pairs.decode(df).collect()}
        assert bytes(out[1]["decoded"]) == library().decode_bytes([72, 73]) and out[1]["extra"] == "kept" and out[2]["decoded"] is None
    words = byte_pairs.vocabulary(FILE)
    with pytest.raises(ValueError, match="offsets"):
        words.decode(np.array([72, 73], "<u4"), np.array([0, 5], "<u4"))
    with pytest.raises(ValueError, match="no token"):
        words.decode(np.array([10**6], "<u4"), np.array([0], "<u4"))


def test_empty_table_and_manifest_paths(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_pairs.decode(byte_pairs.encode(empty)).count() == 0
    paths = spark.createDataFrame([(1, "/sdcard/DCIM/VID_20260102_030405.mkv"), (2, "IMG_1_0.dng")], "ord long, path string")
    out = byte_pairs.decode(byte_pairs.encode(paths, id_column="ord", text_column="path")).collect()
    assert {bytes(r["decoded"]).decode() for r in out} == {"/sdcard/DCIM/VID_20260102_030405.mkv", "IMG_1_0.dng"}
