"""N-gram Jaccard join, embedding near-dedup and components against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafline.llm import components, embedding_dedup, exchange, jaccard_join

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def least_reachable(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text, width=5):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORDS.findall(text or "")]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near_corpus():
    made = random.Random(9)
    word = lambda: "".join(made.choice("abcdefgh") for _ in range(made.randint(2, 7)))
    docs = [None, "", "\n", "a b", "A  b", "a b c", "a b c d e", "a b c d f"]
    for _ in range(6):
        base = [word() for _ in range(made.randint(20, 120))]
        docs.append(" ".join(base))
        for _ in range(made.randint(2, 14)):
            copy = list(base)
            for _ in range(made.randint(0, 4)):
                copy[made.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    chain = [word() for _ in range(60)]
    for k in range(12):  # a chain of which only neighbours are similar
        docs.append(" ".join(chain[k : k + 40]))
    docs += [docs[10]] * 5 + [docs[10].upper()]
    made.shuffle(docs)
    return list(enumerate(docs)) + [(3, docs[3])]


def test_jaccard_against_brute_force(spark):
    rows = near_corpus()
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[b]]
    want = least_reachable(sets, links)
    df = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, id int, sig string")
    got = [tuple(r) for r in jaccard_join.near_duplicates(df).collect()]
    assert Counter(got) == Counter((i, len(sets[i]), want[i]) for i, _ in rows)


@pytest.mark.parametrize("options", [{"most": 3}, {"most": 2, "bucket_bytes": 2000}, {"layout": exchange.Layout(chunks=5, buckets=11, bits=40, coarse=3, group=2)}])
def test_jaccard_in_many_groups_and_hops(spark, options):
    rows = near_corpus()
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[b]]
    want = least_reachable(sets, links)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert Counter(map(tuple, got)) == Counter((i, len(sets[i]), want[i]) for i, _ in rows)


def test_pairs_of_groups_hold_every_pair_of_sets():
    made = np.random.default_rng(6)
    e = np.zeros(60, dtype=jaccard_join.ENTRY)
    e["id"], e["n"], e["component"] = np.arange(60), 50, made.integers(0, 9, 60)
    hot = pa.RecordBatch.from_arrays([pa.array(np.full(60, 7)), pa.array(np.full(60, 4)), pa.array(e["id"]), pa.array(e["n"]), pa.array(e["at"]), pa.array(e["component"])], names=["h", "groups", "id", "n", "at", "component"])
    packed = pa.Table.from_batches(list(jaccard_join._in_pairs_of_groups(5)([hot])))
    found = Counter()
    for b in set(packed["bucket"].to_pylist()):
        t = jaccard_join._across(80)(packed.filter(pa.array([x == b for x in packed["bucket"].to_pylist()])))
        found.update(zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True))
    part = e["component"]
    assert found == Counter((a, b) for a in range(60) for b in range(a + 1, 60) if part[a] != part[b])


def test_jaccard_null_id_and_empty_table(spark):
    schema = "doc_id long, text string"
    assert jaccard_join.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = sorted((tuple(r) for r in jaccard_join.near_duplicates(spark.createDataFrame([(None, "a b c"), (2, "a b c"), (1, "a b c")], schema)).collect()), key=str)
    assert got == [(1, 1, 1), (2, 1, 1), (None, 1, None)]


def vectors():
    made = np.random.default_rng(4)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(5):
            base = made.normal(size=16)
            for _ in range(int(made.integers(1, 12))):
                v = (base + made.normal(size=16) * made.choice([0.05, 0.15, 0.3])) * made.choice([1.0, 3.0])
                rows.append((n, v.astype(np.float32).tolist(), label))
                n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 1), (n + 2, None, 0), (n + 3, [0.0] * 16, 0), (n + 4, [None] + [1.0] * 15, 0), (n + 5, [float("nan")] + [1.0] * 15, 0), (n + 6, [], 0), (n + 7, [1.0, 2.0], 0), (n + 8, [2.0, 4.0], 0), (n + 9, [float("inf")] * 16, 0)]
    return rows


@pytest.mark.parametrize("block", [1024, 7])
def test_cover_tree_pairs_against_brute_force(spark, block):
    rows = vectors()
    links = []
    for a, x, k in rows:
        for b, y, m in rows:
            if a < b and k is not None and k == m and x and y and len(x) == len(y) and None not in x and None not in y:
                p, q = np.array(x, float), np.array(y, float)
                with np.errstate(all="ignore"):
                    cosine = p @ q / (np.sqrt(p @ p) * np.sqrt(q @ q))
                if cosine >= 0.93:
                    links.append((a, b))
    want = least_reachable([r[0] for r in rows], links)
    count = Counter(x for pair in links for x in pair)
    df = spark.createDataFrame([(*r, "z", 0) for r in rows], "vec_id long, embedding array<float>, label int, vector string, times int")
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.near_duplicates(df, block=block).collect()}
    assert got == {r[0]: (count[r[0]], want[r[0]], want[r[0]] == r[0]) for r in rows}
    assert len(links) > 20


def test_dual_pairs_of_two_trees():
    made = np.random.default_rng(8)
    base = made.normal(size=(30, 8))
    x = np.repeat(base, 4, axis=0) + made.normal(size=(120, 8)) * 0.2
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = embedding_dedup.dual_pairs(embedding_dedup.CoverTree(x[:70]), embedding_dedup.CoverTree(x[70:]), 0.9)
    got = {(i, j) for i, j in zip(a.tolist(), b.tolist()) if x[i] @ x[70 + j] >= 0.9}
    assert got == {(i, j) for i in range(70) for j in range(50) if x[i] @ x[70 + j] >= 0.9}


def test_far_cells_are_not_compared(spark):
    """Tight groups far apart: pairs of their cells go before any point is copied."""
    made = np.random.default_rng(8)
    base = np.linalg.qr(made.normal(size=(32, 32)))[0][:8]
    x = np.concatenate([b + 0.03 * made.normal(size=(60, 32)) for b in base])
    df = spark.createDataFrame([(i, [float(v) for v in row], "a") for i, row in enumerate(x)], "vec_id long, embedding array<double>, label string")
    points = df.select("label", F.col("embedding").alias("vector"), F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("times"), F.lit(32).alias("dims"))
    _, cells, centres = embedding_dedup._cells(points, 8)
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in cells.collect()], schema=pa.schema([("label", pa.string()), ("dims", pa.int32()), ("cell", pa.int32()), ("first", pa.int32()), ("blocks", pa.int32()), ("radius", pa.float64())]))
    near = next(embedding_dedup._near(cells, centres, 0.93)([batch]))
    blocks = sum(near["blocks"].to_pylist())
    met = sum(b * len(o) for b, o in zip(near["blocks"].to_pylist(), near["others"].to_pylist(), strict=True))
    assert blocks > 20 and met < 0.3 * blocks * blocks
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.93).sum(axis=1) - 1
    assert [r["n_links"] for r in embedding_dedup.near_duplicates(df, block=8).orderBy("vec_id").collect()] == links.tolist()


def test_embeddings_empty_table(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components(spark):
    made = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(made.randint(50, 90), made.randint(50, 90)) for _ in range(30)] + [(100, x) for x in range(101, 130)] + [(5, 5)]
    want = least_reachable(range(130), edges)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: c for i, c in want.items() if i != c}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_of_one_structure_are_different_shingles(spark):
    """Words that a polynomial modulo 2**64 takes for one do not make unlike documents near copies."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(k, " ".join([w] * 3 + ["x"] + [w] * 4)) for k, w in enumerate((one, other))]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["component_id"] for r in got) == [0, 1]


def test_rows_that_share_an_id_and_very_long_texts(spark):
    """Such rows come out both, as one node of the links of either text; a long text is read whole."""
    made = random.Random(11)
    text = lambda n: " ".join("".join(made.choice("abcdef") for _ in range(6)) for _ in range(n))
    a, b, long = text(50), text(60), text(160_000)
    rows = [(1, a), (5, a), (5, b), (7, b), (8, long), (9, long[: -len(text(3))])]
    got = Counter(tuple(r) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect())
    assert got[8, 8] == got[9, 8] == 1 and got[1, 1] == 1 and sum(n for (i, _), n in got.items() if i == 5) == 2


def test_fragments_are_ranges_of_the_rarity_order(spark):
    """Cut items are all items in order, no fragment has an item before the last one's, and sizes are alike."""
    made = np.random.default_rng(5)
    rows = []
    for k in range(40):
        classes = np.sort(made.integers(4, 30, 50).astype(np.uint8))
        h = made.integers(0, 1 << 63, 50, dtype=np.uint64)
        order = np.lexsort((h, classes))
        rows.append((k, bytearray(h[order].tobytes()), bytearray(classes[order].tobytes())))
    df = spark.createDataFrame(rows, "id long, items binary, classes binary")
    bounds = jaccard_join.fragment_bounds(df, 4)
    cut = df.mapInArrow(jaccard_join._fragments(bounds), "id long, fragment int, items binary").collect()
    place = {k: dict(zip(np.frombuffer(h, np.uint64).tolist(), jaccard_join._places(np.frombuffer(h, np.uint64), np.frombuffer(c, np.uint8)).tolist(), strict=True)) for k, h, c in rows}
    by_fragment = {}
    for r in cut:
        by_fragment.setdefault(r["fragment"], []).extend(place[r["id"]][x] for x in np.frombuffer(r["items"], np.uint64).tolist())
    assert sorted(by_fragment) == [0, 1, 2, 3] and sum(map(len, by_fragment.values())) == 2000
    assert all(max(by_fragment[f]) < min(by_fragment[f + 1]) for f in range(3)) and max(map(len, by_fragment.values())) < 700
