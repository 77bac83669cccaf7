"""Encoding and decoding held against the model's own library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from leafline.llm import piece_codec, queries
from leafline.llm.piece_codec import PieceCodec, readable

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", " a", "a  b", "▁", "▁a▁ b", "\n\n x\t\r", "<s> </s><unk><0x0A>", "日本 𝔘 é", "\x00a", "a​b", "▁▁▁▁▁▁▁ \n"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as f:
        return PieceCodec(f.read())


def lists(ids, offsets):
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]


def test_ids_and_texts_are_the_librarys(codec, library):
    made = random.Random(3)
    texts = [*ODD, "a" * 3000, *("".join(made.choice("ab c▁d\néß日𝔘<>0") for _ in range(made.randrange(200))) for _ in range(300))]
    ids, offsets = codec.encode(texts, True)
    want = library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    assert lists(ids, offsets) == want
    assert codec.decode(ids, offsets) == [library.decode(w) for w in want]
    plain, at = codec.encode(texts, False)
    assert lists(plain, at) == library.encode(texts, num_threads=1)


def test_any_ids_are_decoded_as_the_library_does(codec, library):
    """Broken bytes, control pieces between bytes and at the front, unknown pieces."""
    made = random.Random(4)
    some = [[made.choice([1, 2, 0, 29871, made.randrange(3, 259), made.randrange(3, 259), made.randrange(32000)]) for _ in range(made.randrange(12))] for _ in range(5000)]
    got = codec.decode(np.array([i for x in some for i in x], np.int32), np.cumsum([0] + [len(x) for x in some]))
    assert got == [library.decode(x) for x in some]
    with pytest.raises(ValueError):
        codec.decode(np.array([32000], np.int32), np.array([0, 1]))


def test_a_bad_byte_is_one_mark():
    assert readable(b"a\xe2\x96") == "a��" and readable(b"\xc3\xa9") == "é"


def test_each_distinct_chunk_is_segmented_once(codec, monkeypatch):
    table = piece_codec.ChunkTable(codec.table.bpe, codec.table.merges)
    seen = []
    monkeypatch.setattr(table, "segment", lambda chunks, f=table.segment: seen.extend(chunks) or f(chunks))
    table.encode(["one two one", "two one  two", "x" * 100])
    assert sorted(seen) == sorted({"▁one", "▁two", "▁▁two", "▁" + "x" * 100})
    seen.clear()
    table.encode(["two one", "x" * 100])
    assert seen == ["▁" + "x" * 100]  # long chunks are not kept


def test_a_full_table_begins_again(codec, library):
    table = piece_codec.ChunkTable(codec.table.bpe, codec.table.merges, most_chunks=3, most_ids=9)
    for text in ("a b c d e f", "g a b h", "a"):
        ids, offsets = table.encode([text, text])
        assert lists(ids, offsets) == [library.encode(text)] * 2


def test_chunks_merged_together_are_as_merged_alone(codec):
    made = random.Random(8)
    chunks = list({"".join(made.choice("aabbth▁ei日𝔘nr") for _ in range(made.randrange(1, 64))) for _ in range(3000)})
    flat, size = codec.table.merges.segment(chunks)
    assert [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])] == [codec.table._by_heap(c).tolist() for c in chunks]


@pytest.mark.parametrize("packed", [True, False])
def test_rows_of_every_kind(spark, library, packed):
    """Null, empty, very long and repeated texts, a null id, and columns with clashing names."""
    long = "wörd ▁ 日本\n" * 300_000
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "a b", "y"), (5, long, "x"), *((10 + k, t, "o") for k, t in enumerate(ODD))]
    df = spark.createDataFrame(rows, "doc_id long, text string, `n_tokens` string")
    coded = piece_codec.encode(df, MODEL, packed=packed)
    out = piece_codec.decode(coded, MODEL)
    assert out.columns == ["doc_id", "n_tokens", "ids", "text"]
    got = sorted((r["doc_id"] or 0, r["n_tokens"], hashlib.sha256(bytes(r["ids"]) if packed else np.array(r["ids"], "<i4").tobytes()).hexdigest(), r["text"]) for r in out.collect())
    want = []
    for i, text, other in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((i or 0, other, hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), library.decode(ids)))
    assert got == sorted(want)
    both = piece_codec.encode(df, MODEL, packed=packed, decoded="back")
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["back"]) for r in both.collect()) == sorted((a, b, d) for a, b, _, d in want)


def test_null_ids_empty_tables_and_names_that_are_taken(spark):
    df = spark.createDataFrame([(1, None), (2, [1, 2])], "k int, ids array<int>")
    assert sorted(tuple(r) for r in piece_codec.decode(df, MODEL).select("k", "text").collect()) == [(1, None), (2, "")]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert piece_codec.decode(piece_codec.encode(none, MODEL), MODEL).count() == 0
    with pytest.raises(ValueError):
        piece_codec.encode(none.withColumn("ids", F.lit(1)), MODEL)
    with pytest.raises(ValueError):
        piece_codec.encode(none, MODEL, decoded="doc_id")


def test_the_query_gives_the_librarys_digests(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
