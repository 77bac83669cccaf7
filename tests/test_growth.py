"""Work that must not grow faster than its input, by plans, by counts and against plain versions."""

import random

from leafline.functions import pages
from leafline.operators import markup, matching, tables, tracks


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_line_is_cleaned_once_for_all_its_readings(spark):
    units = spark.createDataFrame([(1, 1, "12 REPORTS 14a\n**7**", 0.0, 10.0, 100.0, 40.0, 1000.0, 1000.0, None)], "k int, unit int, text string, x0 double, y0 double, x1 double, y1 double, width double, height double, zone string")
    found = pages.candidates(units, ["k"])
    assert planned(found).count("*_`~#]+") == 1
    assert sorted((r["detected"], r["side"], r["line"]) for r in found.collect()) == [("12", "left", 0), ("7", "both", 1)]


def test_tables_go_to_python_in_batches(spark):
    df = spark.createDataFrame([(1, "<table><tr><td>a</td></tr></table>")], "k int, html string")
    assert "ArrowEvalPython" in planned(tables.cells(df, ["k"], "html"))


def test_bare_tags_are_read_as_the_parser_reads_them():
    made = random.Random(2)
    parts = ["<b>", "</b>", "<p>", "</P>", "<table>", "<tr>", "<td>", "</td>", "</tr>", "</table>", "<TH>", "</th>", "x", " y\n", "&amp;", "&am", "&lt;b&gt;", "<h2>", "<li>", ">", "<br/>", "<script>", "</script>", "<title>", "<i a='1'>", "<", "<!-- c -->"]

    def parsed(html):
        reader = markup._Reader()
        reader.feed(html)
        reader.close()
        return reader.out and "".join(reader.out), reader.raw, reader.open, reader.parsed

    def said(make, html):
        try:
            return make(html)
        except IndexError:  # a cell that ends in a nested table without rows
            return "no row"

    for k in range(6000):
        html = "".join(made.choice(parts[: 20 if k % 2 else None]) for _ in range(made.randrange(14)))
        want = said(parsed, html)
        got = said(lambda h: (r := markup._read(h)).out and ("".join(r.out), r.raw, r.open, r.parsed) or ([], r.raw, r.open, r.parsed), html)
        assert got == want, html
        assert said(markup.tables_of, html) == (want if want == "no row" else want[3].tables), html


def test_covered_area_by_a_sweep_is_that_of_all_stretches():
    made = random.Random(1)
    for n in range(60):
        span = lambda: sorted(made.sample(range(9), 2))
        some = [(x[0], y[0], x[1], y[1]) for x, y in ((span(), span()) for _ in range(n % 20))]
        cells = {(x, y) for x0, y0, x1, y1 in some for x in range(x0, x1) for y in range(y0, y1)}
        assert matching.covered(some) == len(cells)
    # of this many boxes a walk of all of them for each stretch would take hours
    assert matching.covered([(k, k, k + 2, k + 2) for k in range(30_000)]) == 4 + 3 * 29_999


def test_nearest_rows_make_no_pairs(spark):
    made = random.Random(3)
    rows = lambda n: [(made.randrange(2), k, made.choice([made.randrange(40) / 8, -0.25, float("inf"), float("nan"), None])) for k in range(n)]
    left, right = rows(120), rows(120)
    frame = lambda some: spark.createDataFrame(some, "g int, id int, at double")
    found = matching.nearest_within(frame(left), frame(right), ["g"], "at", "id", 0.25)
    assert "Join" not in planned(found)
    want = []
    for g, k, at in left:
        near = [(abs(at - r), j) for h, j, r in right if h == g and at is not None and r is not None and abs(at - r) <= 0.25]
        want += [(g, k, at, min(near)[1], min(near)[0])] if near else []
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and len(want) > 30


def test_pairs_of_lines_are_no_rows(spark, monkeypatch):
    lines = spark.createDataFrame([(1, k, 200.0 + 0.01 * 90 * k + (40.0 if k % 7 == 3 else 0.0), 90.0 * k) for k in range(30)], "page int, line int, x double, y double")
    found = tracks.proposals(lines, ["page"])
    assert "Join" not in planned(found)
    (best,) = found.collect()
    assert (best["first"], best["second"], best["hugging"], best["outside"]) == (0, 4, 26, 0)
    line = lines.toPandas()
    whole = tracks._best_pair(line["line"].to_numpy(), line["x"].to_numpy(), line["y"].to_numpy(), 1.0, True)
    monkeypatch.setattr(tracks, "BLOCK", 1)
    assert whole == tracks._best_pair(line["line"].to_numpy(), line["x"].to_numpy(), line["y"].to_numpy(), 1.0, True)
