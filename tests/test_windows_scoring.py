"""Windows against every window of every word; pages scored by a model file."""

import numpy as np
import pytest

from leafline.operators import scoring, windows


@pytest.mark.parametrize(("size", "overlap"), [(10, 3), (10, 0), (7, 6), (1, 0), (10, 9)])
def test_every_word_is_in_the_window_with_most_around_it(spark, size, overlap):
    from pyspark.sql import functions as F

    lengths = [0, 1, 2, 5, 9, 10, 11, 13, 17, 18, 24, 40]
    df = spark.createDataFrame([(k, n, "clash") for k, n in enumerate(lengths)], "k int, n int, start string")
    rows = windows.plan(df, ["k"], F.col("n"), size, overlap).collect()
    for k, n in enumerate(lengths):
        mine = sorted((r for r in rows if r["k"] == k), key=lambda r: r["window"])
        assert all(r["end"] - r["start"] <= size for r in mine) and [r["window"] for r in mine] == list(range(len(mine)))
        owner = [min((r for r in mine if r["start"] <= w < r["end"]), key=lambda r: (-min(w - r["start"], r["end"] - w - 1), r["window"]))["window"] for w in range(n)]
        assert [r["window"] for r in mine for _ in range(r["own_end"] - r["own_start"])] == owner
    scored = windows.plan(df, ["k"], F.col("n"), size, overlap).select("k", "own_start", "own_end", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("place"))
    assert sorted(tuple(r) for r in windows.stitched(scored, "place").collect()) == [(k, w) for k, n in enumerate(lengths) for w in range(n)]
    with pytest.raises(ValueError):
        windows.plan(df, ["k"], F.col("n"), 5, 5)


def test_measures_are_relative_to_pages_of_one_side(spark):
    rows = [("v", 1, 5.0), ("v", 3, 9.0), ("v", 5, float("nan")), ("v", 2, 100.0), ("w", 1, None), ("w", 3, None), ("v", 7, None)]
    got = {(r["v"], r["p"]): r["m_rel"] for r in scoring.relative(spark.createDataFrame(rows, "v string, p int, m double"), ["v"], "p", ["m"]).collect()}
    assert got == {("v", 1): -2.0, ("v", 3): 2.0, ("v", 5): None, ("v", 2): 0.0, ("w", 1): None, ("w", 3): None, ("v", 7): None}


def test_a_model_is_fitted_checked_and_applied(spark, tmp_path):
    made = np.random.default_rng(3)
    x = made.normal(size=(300, 2))
    y = (x @ [1.0, -2.0] + made.normal(size=300) * 0.1 > 0).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y, strict=True)] + [(1.0, None, None)], "a double, b double, y int")
    model = scoring.fit(df, ["a", "b"], "y", "1")
    want = np.linalg.lstsq(np.column_stack((np.ones(300), x)), y, rcond=None)[0]
    path = tmp_path / "model.json"
    path.write_bytes(model)
    assert scoring.checked(str(path), scoring.digest(model)) == model
    path.write_bytes(model + b" ")
    with pytest.raises(ValueError):
        scoring.checked(str(path), scoring.digest(model))
    got = {(r["a"], r["b"]): r["score"] for r in scoring.score(df, model).collect()}
    for a, b in x:
        assert got[a, b] == pytest.approx(min(1, max(0, want @ [1, a, b])), abs=1e-6)
    assert got[1.0, None] == pytest.approx(min(1, max(0, want @ [1, 1, 0])), abs=1e-6)
    assert scoring.score(df.drop("b").limit(0), model).count() == 0
