"""Spelling variants against plain Python over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafline.llm import queries, spelling

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_lexicon(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def near(a, b):
    """One inserted, deleted or replaced code point apart."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain_variants(n):
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    close = {w: [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_length.get(size, []) if near(w, v)] for w in n}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] is not None else None))
    return sorted(out, key=lambda r: r[0])


def rows(df):
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("most", [20_000, 3])
def test_variants_of_crowded_words(spark, most):
    """Words over few letters, so that families are large, ties many and chains long; with
    nulls, repeats, capitals, long runs and texts, and clashing names."""
    made = random.Random(7)
    words = ["".join(made.choice("abé") for _ in range(made.randrange(4, 9))) for _ in range(220)] + ["a" * k for k in range(4, 12)] + ["x" * 3000, "x" * 2999 + "y", "x" * 3001, "×÷ÀÿÉ", "×÷àÿÉ"]
    docs = [(k, " ".join(made.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=30))) for k in range(250)]
    docs += [(None, "Banana BANANA banana, bananas;bananas bananas"), (1000, None), (1001, ""), (1001, ""), (1002, "abab1abab2"), (1003, "aaaaa " * 9000), (3, docs[3][1]), *((2000 + k, " ".join(words[-5:])) for k in range(4))]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int")
    got = spelling.variants(df, most=most)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(plain_lexicon(docs))
    assert sum(r[1] is not None for r in want) > 40 and max(r[4] for r in want) > 5
    assert rows(got) == want


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "so few"), (2, None)], "doc_id long, text string")).count() == 0


def test_large_families_are_split(spark):
    """Words that share all but four characters: no family stays above the bound but those of one position."""
    ends = ["".join(p) for p in {tuple(random.Random(k).choices("abcdefgh", k=4)) for k in range(900)}]
    words = spark.createDataFrame([(bytearray(f"prefixprefix{e}suffixsuffix".encode()), 3) for e in ends], "word binary, n long")
    sizes = spelling.families(words, 40).groupBy("size", "lo", "hi", "family").count()
    assert sizes.agg(F.max("count")).first()[0] <= 40
    near_rows = spelling.neighbours(words.select(F.decode("word", "ISO-8859-1").alias("word"), "n"), 40)
    got = {r["word"]: r["n_near"] for r in near_rows.collect()}
    full = [f"prefixprefix{e}suffixsuffix" for e in ends]
    assert got == {w: k for w in full if (k := sum(near(w, v) for v in full))}


@settings(max_examples=60, deadline=None)
@given(st.permutations(range(37)), st.lists(st.tuples(*[st.integers(0, 37)] * 4), max_size=8))
def test_the_tree_reports_every_point_of_a_rectangle_once(values, boxes):
    tree = spelling.WaveletTree(np.array(values))
    x0, x1, y0, y1 = (np.array([b[k] for b in boxes], dtype=np.int64) for k in range(4))
    which, value = tree.report(x0, x1, y0, y1)
    want = [(k, v) for k, (a, b, c, d) in enumerate(boxes) for v in values[a:b] if c <= v < d]
    assert sorted(zip(which.tolist(), value.tolist(), strict=True)) == sorted(want)


def test_trees_of_no_and_one_point():
    for n in (0, 1):
        one = np.array([0]), np.array([n]), np.array([0]), np.array([1])
        assert len(spelling.WaveletTree(np.arange(n)).report(*one)[0]) == n


def test_the_query_gives_the_plain_rows(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows(queries.op11_spelling_variants(spark, SF)) == plain_variants(plain_lexicon(docs))
