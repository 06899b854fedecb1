"""Token codes, packing and counts."""

import functools
import random
import uuid
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cliploom.llm import codes, packing, token_counts
from cliploom.llm.vocab import Encoder, encoder, public_file
from tests.llm import brute

WORDS, BYTES = public_file("word_bpe_49k.json"), public_file("byte_bpe_50k.json")
ODD = [
    "", " ", "\n\n", "  a", "a  b\n\n c", "x<|endoftext|>y <|startoftext|>", "it's we'll I'D '' 's't 12 3a", "a\x1cb \x1d\x1e",
    "a​b 　x\u0085y\xa0z", "é é 日本語 \U0001f389\U0001f389", "\t\tx\r\n y", "a" * 700, "﻿x", "²³ ½ a²",
    "İSTANBUL ΑΣΑΣ", "'''s !'t a b\tc Ǆ ß ẞ ñ", "<|startoftext|", "ŉ ſ K Ɓ Ÿ", " word" * 300,
    *["".join(map(chr, range(i, i + 50))) for i in range(1, 0x500, 50)], *["x " + chr(c) + "'s Y" for c in range(1, 0x260, 3)]]


load = functools.cache(Tokenizer.from_file)


def ids_of(file, text):
    return load(file).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(1)
    rows = [(i * 3 % 101, rng.choice(ODD) + " " + " ".join(rng.choice(ODD[8:14]) for _ in range(rng.randint(0, 4)))) for i in range(101)]
    rows += [(200, None), (201, ""), (50, "again"), (50, "again"), (None, "no id"), (202, "long text, " * 6000)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "'x' AS ids", "2 AS length")


def test_encoder_equals_the_library():
    for code in (Encoder(WORDS), Encoder(BYTES)):
        file = WORDS if code.by_piece else BYTES
        for _ in range(2):  # the second time from the cache
            assert code.encode(ODD) == [np.array(ids_of(file, t), "<u4").tobytes() for t in ODD]
    assert Encoder(WORDS).by_piece and not Encoder(BYTES).by_piece


def test_encoder_with_a_full_cache(monkeypatch):
    from cliploom.llm import vocab

    monkeypatch.setattr(vocab, "CACHE_PIECES", 3)
    code = Encoder(WORDS)
    assert [code.encode([t])[0] for t in ODD] == [np.array(ids_of(WORDS, t), "<u4").tobytes() for t in ODD]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 512, 513, 5000])
def test_codes_round_trip_and_random_access(n):
    ids = np.random.default_rng(n).choice([0, 1, 255, 256, 65535, 65536, 49407, 2**24, 2**32 - 1], n).astype(np.uint32)
    block = codes.pack(ids)
    assert (codes.unpack(block) == ids).all()
    assert (codes.lookup(block, np.arange(n)) == ids).all()
    assert len(codes.lookup(block, np.zeros(0, int))) == 0


def test_code_files(spark, documents, tmp_path):
    rows, df = documents
    path = str(tmp_path / uuid.uuid4().hex)
    codes.write_codes(df, path, segment_tokens=64)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in codes.read_documents(spark, path).collect()))
    want = sorted(((i, [*ids_of(WORDS, t), 1]) for i, t in rows), key=lambda x: (-1 if x[0] is None else x[0]))
    assert [g[1] for g in got] == [i for i, _ in want]
    assert [g[2] for g in got] == [g[3].__len__() // 4 for g in got]
    assert [g[0] for g in got] == np.cumsum([0, *[g[2] for g in got]])[:-1].tolist()
    assert sorted(((i, np.array(ids, "<u4").tobytes()) for i, ids in want), key=repr) == sorted(((g[1], g[3]) for g in got), key=repr)
    sums = sorted((r["start"], r["ids_crc32"]) for r in codes.read_documents(spark, path, checksums=True).collect())
    assert sums == [(g[0], zlib.crc32(g[3])) for g in got]
    stream = np.frombuffer(b"".join(g[3] for g in got), "<u4")
    places = [0, 1, len(stream) - 1, 77, 77, len(stream), -1, None]
    asked = spark.createDataFrame([(p,) for p in places], "place long")
    found = sorted(((r["place"], r["token_id"]) for r in codes.tokens_at(asked, path).collect()), key=repr)
    assert found == sorted(((p, int(stream[p]) if p is not None and 0 <= p < len(stream) else None) for p in places), key=repr)


def test_code_files_of_no_documents(spark, tmp_path):
    path = str(tmp_path / "none")
    codes.write_codes(spark.createDataFrame([], "doc_id long, text string"), path)
    assert codes.read_documents(spark, path).count() == 0


def test_packer_is_best_fit_in_bounded_space():
    rng = random.Random(5)
    for open_bins in (1, 2, 3, 8, 1000):
        lengths = [rng.choice([1, 2, 3, 5, 8, 13, 20, 31, 32]) for _ in range(400)]
        packer = packing.Packer(32, open_bins)
        assert [packer.place(n) for n in lengths] == brute.best_fit(lengths, 32, open_bins)


def test_packing(spark, documents):
    rows, df = documents
    out = packing.pack(packing.token_pieces(df, size=64), size=64, group_pieces=50).toPandas()
    want = []
    for i, t in rows:
        ids = np.array([*ids_of(WORDS, t), 1], "<u4")
        want += [(i, n, 64 * n, len(ids[64 * n : 64 * n + 64]), zlib.crc32(ids[64 * n : 64 * n + 64].tobytes())) for n in range(-(-len(ids) // 64))]
    got = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == np.cumsum([0, *s["length"]])[:-1].tolist() and s["length"].sum() <= 64
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 64) * 1.02 + out["sequence_id"].floordiv(2**32).nunique()


def test_packing_of_odd_lengths_and_nothing(spark):
    pieces = spark.createDataFrame([(1, 5, "a"), (2, 0, "b"), (3, None, "c"), (4, 65, "d"), (1, 5, "a")], "doc_id long, length long, offset string")
    out = {(r["doc_id"], r["offset"] is None, r["sequence_id"] is None) for r in packing.pack(pieces, size=64).collect()}
    assert out == {(1, False, False), (2, True, True), (3, True, True), (4, True, True)}
    assert packing.pack(spark.createDataFrame([], "doc_id long, length long")).count() == 0
    assert packing.pack(packing.token_pieces(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_counts_equal_the_library():
    count = token_counts.Counter(BYTES).count
    for _ in range(2):
        assert [count(t) for t in ODD] == [len(ids_of(BYTES, t)) for t in ODD]


def test_counts_of_documents(spark, documents):
    rows, df = documents
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(df).collect()), key=repr)
    n = [(i, len((t or "").encode()), len(ids_of(BYTES, t))) for i, t in rows]
    assert got == sorted(((i, b, k, k > 512) for i, b, k in n), key=repr)
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_encoder_a_worker():
    assert encoder(WORDS) is encoder(WORDS)
