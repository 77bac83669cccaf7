"""The filter audit against plain Python: every order replayed over every document."""

from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafline.llm import filter_audit, kernels

SEPARATORS = " \t\n\v\f\r"


def plain_words(text):
    for c in SEPARATORS:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def fails(text):
    words = plain_words(text)
    return {
        *("A" if len(words) < 200 else ""),
        *("B" if 100 * len(set(words)) < 50 * len(words) else ""),
        *("C" if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else ""),
        *("D" if set(text) & set("#$%&*|") else ""),
    }


def replay(docs, labels):
    """Rows by applying the filters of each order, one after another, to lists of documents."""
    says = {}
    for i, quality, toxic in labels:
        good, bad = says.get(i, (False, False))
        says[i] = (good or quality == 1, bad or toxic == 1)
    known = [(lang or "", fails(text or "") | ({"E"} if i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs) else set()), *says.get(-1 if i is None else i, (False, False))) for i, text, lang in docs]
    out, removed_by = {}, Counter()
    for part in {k[0] for k in known}:
        for order in permutations("ABCDE"):
            left = [k for k in known if k[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                off = [k for k in left if f in k[1]]
                left = [k for k in left if f not in k[1]]
                out[part, "".join(order), step] = [len(left), len(off), sum(f in k[1] for k in gone), sum(k[1] == {f} for k in known if k[0] == part), sum(k[2] for k in off), sum(k[3] for k in off)]
                removed_by[part, f] += len(off)
                gone += off
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_every_order_is_as_replayed(spark):
    """Nulls in every column, empty, long and repeated texts, ties at each bound, odd labels, clashing names."""
    word = [f"w{k}" for k in range(300)]
    base = " ".join(word[:200])
    texts = [
        None, "", "a b", base, base, base, " ".join(word[:199]), " ".join(word[:100] * 2), " ".join([*word[:99] * 2, "x", "x"]),
        base + "#", "A" * 30 + base[:970], "A" * 31 + base[:969], "é" * 970 + "A" * 30, "É À" * 300, "\t".join(word) + "\v\f\r\n", "w\x00w " * 250, "pipe | " * 90, (base + " ") * 3000,
    ]
    langs = ["en", "de", None, ""]
    docs = [(k, t, langs[k % 4]) for k, t in enumerate(texts)]
    docs += [(3, base, "en"), (None, base, "en"), (None, "a b", None), (40, "", "fr"), (41, None, "fr"), (7, base, "de"), (7, texts[7], "de")]
    labels = [(k, k % 2, k % 3 % 2) for k in range(12)] + [(3, 1, 1), (3, 0, 0), (4, None, 1), (None, 1, 1), (99, 1, 1)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, digest string, part int")
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == ["part", "filter_order", "step", *names]
    rows = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got.collect()}
    want = replay(docs, labels)
    assert len(rows) == 120 * 5 * len({d[2] or "" for d in docs}) and rows == want


def test_one_text_of_a_third_of_all_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    first = filter_audit.audit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'EABCD' and step = 1").first()
    assert (first["removed"], first["kept"]) == (999, 2001)


def test_no_documents_no_rows(spark):
    assert filter_audit.audit(spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_words_of_one_hash_are_told_apart():
    texts = ["aa bb aa cc", "x", "", "aa aa", "bb aaa bb aa"]
    data, off = kernels.column_bytes(pa.array(texts))
    starts, ends, word_off = kernels.word_bounds(data, off)
    for hashes in (None, np.zeros(len(starts), np.uint64), (ends - starts).astype(np.uint64)):
        assert filter_audit.distinct_words(data, starts, ends, word_off, hashes).tolist() == [3, 1, 0, 1, 3]


def test_words_whose_hashes_meet_by_design():
    """Halves of a Thue-Morse word, which a polynomial modulo 2**64 takes for equal."""
    half = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = half.translate(str.maketrans("ab", "ba"))
    data, off = kernels.column_bytes(pa.array([f"{half} {other} {half}"]))
    assert filter_audit.distinct_words(data, *kernels.word_bounds(data, off)).tolist() == [2]


def test_the_mask_column_must_be_new(spark):
    with pytest.raises(ValueError):
        filter_audit.masked(spark.createDataFrame([("a", 1)], "text string, mask int"))
