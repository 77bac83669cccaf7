"""Suffix-array and substring dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from leafline.llm import exchange, kernels, substring_dedup, suffix_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, kept string, chunk int"


def corpus():
    """Shared passages, copies, repeats inside a document, long and empty texts, runs of one letter."""
    made = random.Random(3)
    word = lambda: "".join(made.choice("abcdeé") for _ in range(made.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(5)]
    docs = [None, "", " \n\t ", "one", "a" * 700, "b" * 450 + " " + "a" * 300, text(4000), "é" * 300]
    docs += [text(made.randint(0, 30)) + " " + made.choice(shared) + "  \n" + text(made.randint(0, 30)) for _ in range(40)]
    docs += [docs[9], docs[9], shared[0] + " x " + shared[0], shared[1][:230], shared[1][5:205], text(10) + docs[6][100:900]]
    rows = [(i, d, "clash", i) for i, d in enumerate(docs)] + [(11, docs[11], "clash", 1), (None, docs[12], None, None)]
    return rows


def removed_words(rows, window):
    words = [WORDS.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), kept.encode()))
    return out


def removed_bytes(rows, length):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def test_words_against_brute_force(spark):
    rows = corpus()
    got = substring_dedup.remove_repeated(spark.createDataFrame(rows, SCHEMA), window=35).collect()
    have = Counter((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in got)
    assert have == Counter((r[0], *w) for r, w in zip(rows, removed_words(rows, 35), strict=True))
    assert all(sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in got)


@pytest.mark.parametrize("length", [64, 200])
def test_bytes_against_brute_force(spark, length):
    rows = corpus()
    got = suffix_dedup.remove_repeated(spark.createDataFrame(rows, SCHEMA), length=length, seed=24 if length == 64 else 48).collect()
    have = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in got)
    assert have == Counter((r[0], *w) for r, w in zip(rows, removed_bytes(rows, length), strict=True))


TWO_HOPS = exchange.Layout(chunks=7, buckets=23, bits=40, coarse=3, group=2)


def test_words_in_two_hops(spark):
    rows = corpus()
    got = substring_dedup.remove_repeated(spark.createDataFrame(rows, SCHEMA), window=35, layout=TWO_HOPS).collect()
    have = Counter((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in got)
    assert have == Counter((r[0], *w) for r, w in zip(rows, removed_words(rows, 35), strict=True))


def test_bytes_in_two_hops(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_RANGES", 6)  # so each range is dealt on to four buckets
    rows = corpus()
    got = suffix_dedup.remove_repeated(spark.createDataFrame(rows, SCHEMA), layouts=(TWO_HOPS, TWO_HOPS)).collect()
    have = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in got)
    assert have == Counter((r[0], *w) for r, w in zip(rows, removed_bytes(rows, 200), strict=True))


@pytest.mark.parametrize("gigabytes", [30, 1000, 100_000])
@pytest.mark.parametrize("sizes", [{}, {"bytes_per_key": 76}, {"bytes_per_key": 256, "bucket_keys": 32768, "least_keys": 4}, {"chunk_bytes": 8 << 20, "bytes_per_key": 8}])
def test_messages_follow_the_keys(gigabytes, sizes):
    total = gigabytes * 10**9
    layout = exchange.Layout.sized(total, 1000, **sizes)
    keys = total // sizes.get("bytes_per_key", 6)
    least = 4 if "least_keys" in sizes else 20 if "bytes_per_key" in sizes else 100
    # keys that each hop carries, a message
    hops = 1 if not layout.coarse else 3
    assert hops * keys / layout.messages() >= least or layout.messages() <= 1 << 20
    if layout.coarse:
        assert layout.group * keys / layout.chunks / layout.coarse <= 2 * sizes.get("bucket_keys", exchange.BUCKET_KEYS) and layout.buckets < 1 << 24


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.remove_repeated(none).count() == 0
    assert suffix_dedup.remove_repeated(none).count() == 0


def test_whole_characters_and_carried_columns(spark):
    same = "é" * 150
    df = spark.createDataFrame([(1, "x" + same + "yz", "k1", 1), (2, "u" + same + "vw", "k2", 2)], SCHEMA)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeated(df, carry=("chunk",), whole_characters=True).collect()}
    assert bytes(got[1]["kept"]).decode() == "xyz" and got[2]["chunk"] == 2


def test_equal_suffixes():
    import numpy as np

    made = random.Random(1)
    flat = bytes(made.choice(b"ab") for _ in range(4000)) + b"a" * 300
    data, starts = np.frombuffer(flat, np.uint8), np.arange(len(flat) - 12)
    seen = Counter(flat[i : i + 12] for i in starts.tolist())
    assert suffix_dedup.equal_suffixes(data, starts, 12).tolist() == [seen[flat[i : i + 12]] > 1 for i in starts.tolist()]


def test_packing_round_trip():
    import numpy as np

    made = np.random.default_rng(2)
    for n in (0, 1, 9, 1000):
        keys = np.unique(made.integers(0, 1 << 63, n, dtype=np.uint64))
        flags = made.integers(0, 2, len(keys)).astype(bool)
        back = exchange.unpack(exchange.pack(keys, flags, b"more"))
        assert (back[0] == keys).all() and (back[1] == flags).all() and back[2] == b"more"


def test_word_hashes_depend_on_the_word_alone():
    import numpy as np

    text = "ab cd  ab\nab\x0bé é".encode()
    data, off = np.frombuffer(text * 2, np.uint8), np.array([0, len(text), 2 * len(text)])
    starts, ends, word_off = kernels.word_bounds(data, off)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    hashes = kernels.word_hashes(data, starts, ends).tolist()
    assert words == text.split() * 2 and word_off.tolist() == [0, 6, 12]
    assert len(set(hashes)) == len(set(words)) and all((a == b) == (x == y) for a, x in zip(words, hashes, strict=True) for b, y in zip(words, hashes, strict=True))


def test_kept_digest_of_contract(spark):
    got = substring_dedup.remove_repeated(spark.createDataFrame([(1, "a  b\nc", None, None)], SCHEMA)).first()
    assert hashlib.sha256(bytes(got["kept"])).hexdigest() == hashlib.sha256(b"a b c").hexdigest()


def thue_morse():
    """Two words of 1,024 letters that every polynomial modulo 2**64 takes for one."""
    half = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    return half, half.translate(str.maketrans("ab", "ba"))


def test_words_of_one_structure_are_different_words(spark):
    """Windows that differ in such a word alone are different windows."""
    one, other = thue_morse()
    rest = [f"w{k}" for k in range(34)]
    rows = [(0, " ".join([*rest, one])), (1, " ".join([*rest, other]))]
    got = substring_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"), window=35).collect()
    assert [r["n_removed"] for r in got] == [0, 0]


def test_word_hashes_of_blocks_meet_only_in_equal_words():
    made = random.Random(12)
    words = {"".join(made.choice("ab\0") for _ in range(n)) for n in range(1, 40) for _ in range(60)} | set(thue_morse()) | {"\0" * n for n in range(1, 30)}
    words = sorted(w for w in words if not set(w) & set(" \t\n\v\f\r"))
    data, off = kernels.column_bytes(pa.array([" ".join(words) + " " + " ".join(reversed(words))]))
    starts, ends, _ = kernels.word_bounds(data, off)
    h = kernels.word_hashes(data, starts, ends).tolist()
    assert h[: len(words)] == h[len(words) :][::-1] and len(set(h)) == len(words)


@pytest.mark.parametrize("total", [30 * 10**9, 10**12, 100 * 10**12])
@pytest.mark.parametrize("repeated", [0.0, 0.001, 0.3])
def test_buckets_follow_the_input_where_sampled_leads_repeat(total, repeated):
    to = exchange.Layout.sized(total, 200, bytes_per_key=suffix_dedup.CONTEXT_BYTES, bucket_keys=(8 << 20) // suffix_dedup.CONTEXT_BYTES, least_keys=suffix_dedup.LEAST_CONTEXTS)
    made = np.random.default_rng(5)
    leads = sorted([b"x" * 124] * int(32_000 * repeated) + [made.bytes(124) for _ in range(32_000 - int(32_000 * repeated))])
    many = min(to.buckets, suffix_dedup.MOST_RANGES)
    deal = suffix_dedup.Dealt(np.unique(np.array([leads[len(leads) * b // many] for b in range(1, many)], dtype="S124")), to)
    buckets = (len(deal.splitters) + 1) * deal.parts
    assert to.buckets <= buckets <= 2 * to.buckets
    found = deal.buckets(leads[::7])
    assert min(found) >= 0 and max(found) < buckets


def test_anchors_are_the_same_in_texts_of_any_length(monkeypatch):
    """Windows name the same place whatever is around them, over the bounds of a run of places."""
    made = random.Random(2)
    text = "".join(made.choice("ab") for _ in range(9000)).encode()
    data, off = kernels.column_bytes(pa.array([text, text[1234:5000]]))
    plain = suffix_dedup.anchors(data, off, 200, 48)
    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", 10)
    for a, b in zip(plain, suffix_dedup.anchors(data, off, 200, 48), strict=True):
        if a.dtype != np.uint64:
            assert len(a) and len(b)
    places = dict(zip(range(len(text)), range(len(text)), strict=True))
    h = np.array([made.getrandbits(64) for _ in places], dtype=np.uint64)
    for width in (1, 5, 153):
        got = suffix_dedup._places_of_least(h, width)
        cut = (h >> np.uint64(10)).tolist()
        assert got.tolist() == [min(range(k, k + width), key=lambda j: (cut[j], j)) for k in range(len(h) - width + 1)]


def test_a_text_longer_than_a_block_is_read_whole(spark):
    made = random.Random(4)
    long = " ".join("".join(made.choice("abcdef") for _ in range(6)) for _ in range(2 * kernels.BLOCK_BYTES // 7))
    tail = " ".join(long.split(" ")[-40:])
    rows = [(0, long), (1, tail), (2, long[-300:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = {r["doc_id"]: r for r in substring_dedup.remove_repeated(df, window=35).collect()}
    assert (words[0]["n_words"], words[1]["n_removed"]) == (len(long.split()), 40) and words[0]["n_removed"] >= 40
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeated(df, length=200).collect()}
    assert (got[0]["n_bytes"], got[2]["n_removed"]) == (len(long), 300) and got[0]["n_removed"] >= 300
