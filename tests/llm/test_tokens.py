"""Byte-level BPE and packed token ids."""

import hashlib
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioquery.llm import bitpack, bpe, pieces

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
BPE = bpe.ByteBPE(RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

ODD = ["", " ", "a", "the", "  \n\t x", "''s don't", "漢字🙂 ²½", "\x1c\x85 é", "=-" * 400, "ab" * 3000, "<|endoftext|> x", " " * 2000 + "y", "ÿ" * 700]


@pytest.mark.parametrize("text", ODD)
def test_bpe_equals_the_library(text):
    ids = BPE.encode(text)
    assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert BPE.decode(ids).decode() == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(list("abceth E\n\t'_é漢🙂²01.") + ["ing", " the"]), max_size=80).map("".join) | st.text(max_size=40))
def test_bpe_equals_the_library_on_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert BPE.encode(text).tolist() == LIBRARY.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(list("aabcehint_é")), min_size=2, max_size=90).map("".join))
def test_a_tree_of_its_own_equals_the_library(text):
    ids = np.frombuffer(BPE.merge_one(text.encode()), "<u4").tolist()
    assert ids == LIBRARY._encode_single_piece(text.encode())


def test_one_long_match_is_quick():
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(200_000))
    began = time.process_time()
    ids = BPE.encode(text)
    assert time.process_time() - began < 60 and BPE.decode(ids) == text.encode()
    assert len(BPE.cache.young) == 0 or max(map(len, BPE.cache.young)) <= bpe.CACHE_BYTES
    assert BPE.encode(text[:9000]).tolist() == LIBRARY.encode_ordinary(text[:9000])


def test_long_texts_go_in_portions(monkeypatch):
    text = "some words and more, " * 500
    want = BPE.encode(text).tolist()
    monkeypatch.setattr("folioquery.llm.pieces.LONG", 1000)
    monkeypatch.setattr("folioquery.llm.pieces.PORTION", 37)
    assert BPE.encode(text).tolist() == want == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("around", [["", "long"], ["long", "", "long"], ["long", "", "x", "long", ""]])
def test_long_texts_beside_empty_ones_are_whole(monkeypatch, around):
    monkeypatch.setattr("folioquery.llm.pieces.PORTION", 37)
    monkeypatch.setattr(pieces.by_volume, "__defaults__", (1000,))
    monkeypatch.setattr("folioquery.llm.pieces.LONG", 1000)
    texts = ["some words and more, " * 500 if t == "long" else t for t in around]
    assert all(len(g) == 1 for g in pieces.by_volume(texts) if any(len(texts[i]) > 1000 for i in g))
    own = [b""] * len(texts)
    for i, ids in BPE.encode_many(texts):
        own[i] += ids
    library = bitpack.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json")).encode_many(texts)
    for t, a, b in zip(texts, own, library):
        assert np.frombuffer(a, "<u4").tolist() == LIBRARY.encode_ordinary(t)
        assert np.frombuffer(b, "<u4").tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids


def test_documents_beside_null_ones_are_whole(spark):
    text = "a b " * 300_000
    docs = spark.createDataFrame([(1, None), (2, text), (3, None), (4, text)], "doc_id long, text string").coalesce(1)
    rows = {r["doc_id"]: r for r in bpe.encode_documents(docs, with_ids=False).collect()}
    assert {rows[i]["decoded_sha256"] for i in (2, 4)} == {hashlib.sha256(text.encode()).hexdigest()}
    assert rows[1]["n_tokens"] == rows[3]["n_tokens"] == 0


def test_bpe_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = bpe.query(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r["doc_id"]])
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def test_bpe_corner_cases(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "x y", 9), (3, "x y", 9), (3, "x y", 9)], "doc_id long, text string, n_tokens int")
    rows = bpe.encode_documents(docs).collect()
    assert sorted(r["n_tokens"] for r in rows) == [0, 0, 2, 2, 2]
    assert all(BPE.decode(np.frombuffer(r["ids"], "<u4")) in (b"", b"x y") for r in rows)
    assert bpe.encode_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 7, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000, 4097):
        x = rng.integers(0, 1 << bits, n).astype("<u4")
        raw = bitpack.pack(x, bits)
        assert len(raw) == -(-n * bits // 8) and (bitpack.unpack_stream(raw, n, bits) == x).all()


def test_segments_read_at_random():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50257, n).astype("<u4") for n in (0, 5, 9000, 1, 4096, 3)]
    s = bitpack.Segment(bitpack.write_segment([1, None, 3, 4, 5, 6], docs, 16))
    every = np.concatenate(docs)
    assert s.doc_ids == [1, None, 3, 4, 5, 6] and all((s.document(k) == d).all() for k, d in enumerate(docs))
    for a, b in ((0, 0), (0, len(every)), (4090, 4100), (8191, 8193), (13000, len(every))):
        assert (s.unpack(a, b) == every[a:b]).all()
    with pytest.raises(ValueError):
        bitpack.Segment(b"FQBX" + bytes(60))


def test_library_encoder_equals_the_library():
    encoder = bitpack.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text, ids in zip(ODD, encoder.encode_many(ODD)):
        assert np.frombuffer(ids, "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids, text


def expected(rows):
    at, out = 0, []
    for doc_id, text in rows:
        ids = np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_bitpack_query(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(bitpack, "SEGMENT_IDS", 5000)
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = sorted(tuple(r) for r in bitpack.query(spark, sf_dir).collect())
    assert got == expected(docs)


def test_frequent_and_null_ids_are_spread(spark, tmp_path):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bitpack.write_packed(docs, str(tmp_path / "a"))
    shards = {r["shard"]: r["n"] for r in spark.read.parquet(str(tmp_path / "a")).groupBy("shard").agg(F.sum("n_docs").alias("n")).collect()}
    assert len(shards) >= 6 and max(shards.values()) <= 300
    got = sorted((tuple(r) for r in bitpack.read_packed(spark, str(tmp_path / "a")).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    again = bitpack.read_packed(spark, str(tmp_path / "a"))
    bitpack.write_packed(docs.repartition(5), str(tmp_path / "b"))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, bitpack.read_packed(spark, str(tmp_path / "b")).collect()))


def test_bitpack_corner_cases(spark, tmp_path):
    rows = [(None, "null id"), (1, None), (2, ""), (5, "b" * 50_000), (7, "x"), (7, "x"), (9, "漢字 <|endoftext|>")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    bitpack.write_packed(docs, str(tmp_path / "a"))
    got = sorted((tuple(r) for r in bitpack.read_packed(spark, str(tmp_path / "a")).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    some = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in bitpack.document_ids(spark, str(tmp_path / "a"), [5, 9, 4, 9]).collect()}
    assert some == {i: TOKENIZER.encode(t, add_special_tokens=False).ids + [0] for i, t in rows if i in (5, 9)}
    assert bitpack.document_ids(spark, str(tmp_path / "a"), []).count() == 0
    bitpack.write_packed(docs.limit(0), str(tmp_path / "b"))
    assert bitpack.read_packed(spark, str(tmp_path / "b")).count() == 0
