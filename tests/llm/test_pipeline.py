"""Mixing against its definition, and the pipeline's stages against what they promise."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafline.llm import mixing

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_exponent_meets_entropy_and_repeats():
    tokens = {"a": 9000, "b": 500, "c": 100, "d": 0}
    a = mixing.exponent_for(tokens, 9600, 0.8, 4)
    assert mixing.entropy(mixing.weights(tokens, a)) == pytest.approx(0.8 * math.log(3), abs=1e-6)
    a = mixing.exponent_for(tokens, 9600, None, 4)
    w = mixing.weights(tokens, a)
    assert max(w[s] * 9600 / tokens[s] for s in w) == pytest.approx(4, rel=1e-6)
    assert mixing.exponent_for({}, 0, 0.5, 4) == 1.0 and mixing.exponent_for({"a": 5}, 5, 0.5, 4) == 0.0


@pytest.mark.parametrize("tokens", [{"a": 1000, "b": 990, "c": 970, "d": 960}, {"a": 10**12, "b": 10**12 - 1, "c": 10**12 - 2}, {None: 7, "b": 7, "c": 6, "d": 6, "e": 5}])
def test_exponent_when_the_natural_entropy_is_above_the_target(tokens):
    total = sum(tokens.values())
    goal = 0.9 * math.log(len(tokens))
    assert mixing.entropy(mixing.weights(tokens, 1.0)) > goal + 0.01
    a = mixing.exponent_for(tokens, total, 0.9, 4)
    assert a > 1 and mixing.entropy(mixing.weights(tokens, a)) == pytest.approx(goal, abs=1e-4)


def test_exponent_when_no_exponent_meets_the_target():
    with pytest.warns(UserWarning, match="no exponent"):
        assert mixing.exponent_for({"a": 5, "b": 5, "c": 5}, 15, 0.9, 4) == 1.0


@pytest.mark.parametrize("budget", [None, 3000, 100])
def test_schedule_meets_the_quotas(spark, budget):
    made = random.Random(4)
    rows = [(i, made.choice(["a"] * 12 + ["b", "b", None]), made.randint(0, 40), "c", 1) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long, m_source string, epochs int").drop("m_source")
    total = {}
    for _, s, n, *_ in rows:
        total[s] = total.get(s, 0) + n
    use = budget or sum(total.values())
    w = mixing.weights(total, mixing.exponent_for(total, use, 0.9, 4.0))
    got = mixing.schedule(df, budget=budget, block_tokens=300).collect()
    for s in total:
        quota, largest = int(w[s] * use), max(n for _, t, n, *_ in rows if t == s)
        assert quota <= sum(r["tokens"] for r in got if r["source"] == s) < quota + largest + 1
    times = {}
    for r in got:
        times.setdefault((r["source"], r["doc_id"]), set()).add(r["epoch"])
    assert all(e == set(range(len(e))) for e in times.values()) and len(got) == sum(map(len, times.values()))
    for s in total:  # no document is used twice more often than another
        used = [len(times.get((s, i), ())) for i, t, *_ in rows if t == s]
        assert max(used) - min(used) <= 1
    assert got and sorted(got) == sorted(mixing.schedule(df, budget=budget, block_tokens=300).collect())


def test_schedule_against_a_replay(spark):
    """Blocks, their order, quotas and the cut, built again from the hashes alone."""
    made = random.Random(14)
    rows = [(i, made.choice(["a"] * 9 + ["b", "b", None]), made.randint(0, 40)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    seed, size = 17, 300
    places = {r[0]: (r[1], r[2]) for r in df.select("doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("p"), F.xxhash64(F.xxhash64(F.lit(seed), "doc_id"))).collect()}
    ranks = {r[0]: r[1] for r in spark.range(60).select(F.col("id").cast("int"), F.xxhash64(F.lit(seed), F.col("id").cast("int"))).collect()}
    total = {}
    for _, s, n in rows:
        total[s] = total.get(s, 0) + n
    budget = sum(total.values())
    w = mixing.weights(total, mixing.exponent_for(total, budget, 0.9, 4.0))
    want = Counter()
    for s, n in total.items():
        blocks = max(1, math.ceil(n / size))
        dealt = {}
        for i, t, tokens in rows:
            if t == s:
                dealt.setdefault(places[i][1] % blocks, []).append((places[i][0], i, tokens))
        passes, rest = divmod(int(w[s] * budget), n)
        for rank, b in enumerate(sorted(dealt, key=lambda b: (ranks[b], b)), 1):
            took = 0
            for _, i, tokens in sorted(dealt[b]):
                more = took < rest
                took += tokens
                want.update({(i, s, e, b, rank): 1 for e in range(passes + more)})
            rest = max(0, rest - took)
    got = Counter((r["doc_id"], r["source"], r["epoch"], r["block"], r["block_rank"]) for r in mixing.schedule(df, block_tokens=size).collect())
    # documents without tokens after the cut's last place may or may not share the last pass
    free = {i for i, _, n in rows if n == 0}
    assert {k: v for k, v in got.items() if k[0] not in free} == {k: v for k, v in want.items() if k[0] not in free}


def test_stages_keep_columns_with_clashing_names(spark):
    names = ["score", "lang_pred", "removed", "n_removed", "kept", "n_bytes", "epoch", "block", "place", "block_rank", "row", "digest", "at", "rank", "count", "carried", "gone_id", "m_row", "a.b"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id"), F.lit(0))) for c in names}).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    first = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        if name != "source_mixing":
            assert docs.columns == first
    rows = docs.collect()
    assert docs.columns == [*first, "epoch_", "block_", "block_rank_", "place_"] and len(rows) > 20
    for r in rows:
        assert all(r[c] == f"{c}-{r['doc_id'] or 0}" for c in names) and r["m"] == {"k": r["doc_id"]} and r["epoch_"] >= 0


def test_empty_schedule_and_word_counts(spark):
    assert mixing.schedule(spark.createDataFrame([], "doc_id long, source string, tokens long")).count() == 0
    df = mixing.count_words(spark.createDataFrame([("a b\n c",), (None,), ("",), ("x" * 10**6 + " y",)], "text string"), "text")
    assert [r["tokens"] for r in df.collect()] == [3, 0, 0, 2]


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(1).collect()][0]
    base = docs.where("lang = 'en' AND n_chars BETWEEN 1500 AND 4000").orderBy("doc_id").first()
    other = docs.where("lang = 'en' AND n_chars BETWEEN 1500 AND 4000").orderBy("doc_id").collect()[5]
    words = base["text"].split(" ")
    near = " ".join(w if k % 97 else "changed" for k, w in enumerate(words))
    planted = [(10**6, near, "en", "s", 0), (10**6 + 1, "12 34 !", "en", "s", 0), (10**6 + 2, other["text"][:900] + " " + bench, "en", "s", 0), (10**6 + 3, None, None, None, None), (10**6 + 4, "", "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema)).persist()
    kept, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        before = stage(spark, before, SF).persist()
        kept[name] = before
        if name != "source_mixing":
            assert before.columns == COLUMNS
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in kept.items()}
    assert not {10**6 + 1, 10**6 + 3, 10**6 + 4} & ids["language_id"] and len(ids["language_id"]) >= docs.count() - 6
    assert 10**6 not in ids["ngram_jaccard_join"] and base["doc_id"] in ids["ngram_jaccard_join"]
    cut = {r["doc_id"]: r for r in kept["suffix_array_dedup"].collect()}
    assert other["text"][:850] not in cut.get(10**6 + 2, {"text": ""})["text"] and all(len(r["text"]) == r["n_chars"] for r in cut.values())
    assert 10**6 + 2 not in ids["benchmark_decontamination"]
    assert ids["source_mixing"] <= ids["benchmark_decontamination"] and len(ids["source_mixing"]) > 50


def test_one_row_of_each_class_stays(spark):
    made = random.Random(12)
    text = lambda: " ".join("".join(made.choice("abcdefghij") for _ in range(7)) for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    near = c.rsplit(" ", 1)[0] + " other"
    rows = [(1, a, "en", "s", 0)] * 3 + [(None, b, "en", "s", 0), (None, b, "en", "t", 0)] + [(7, near, "en", "s", 0), (5, c, "en", "s", 0), (5, c, "en", "s", 0), (None, c, "en", "s", 0)]
    rows += [(9, d, "en", "s", 0), (9, e, "en", "s", 0), (None, f, "en", "s", 0), (2, " " * 150, "en", "s", 0), (2, " " * 150, "en", "s", 0), (2**63 - 1, a[:50], "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    want = sorted([(1, a), (None, b), (5, c), (9, d), (9, e), (None, f), (2, " " * 150), (2**63 - 1, a[:50])], key=str)
    stayed = corpus_pipeline.one_of_near_copies(spark, docs, SF).persist()
    assert sorted(((r["doc_id"], r["text"]) for r in stayed.collect()), key=str) == want
    assert {r["source"] for r in stayed.collect()} == {"s"}
    assert sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.without_repeats(spark, stayed, SF).collect()), key=str) == want


def test_contaminated_rows_with_null_ids_go(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(None, "before " + item, "en", "s", 0), (None, "nothing of it", "en", "s", 0), (3, item + " after", "en", "s", 0), (4, "nor here", "en", "s", 0), (None, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = corpus_pipeline.without_benchmark(spark, docs, SF).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(None, "nothing of it"), (4, "nor here"), (None, None)], key=str)


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
