"""Writings, notes, syllabus and boxes on rows made by hand, and joined boxes against a slow version."""

import random

import pytest
from pyspark.sql import functions as F

from leafline.functions import boxes
from leafline.operators import consensus, matching, pages, writings

SPANS = "k int, i long, tagged boolean, caption boolean, author boolean, opens boolean, separate boolean"


def made(spark, *flags, k=1):
    """One letter a paragraph: t tagged, c caption, m author of the majority, d of a dissent, j judge inside, - none."""
    rows = [(k, i, f != "-", f == "c", f in "mdj", f in "md", f == "d") for i, f in enumerate("".join(flags))]
    return spark.createDataFrame(rows, SPANS)


@pytest.mark.parametrize(
    ("flags", "split", "starts"),
    [
        ("tt-mxx".replace("x", "-"), 2, [2]),  # an untagged line, then the majority's own author
        ("tt-d--", 2, [2, 3]),  # no author of the majority: the first is a dissent's
        ("ttm--d-d", 2, [2, 5, 7]),
        ("t-c-m-j-d", 3, [3, 8]),  # the last caption is behind the leading run; a judge in a sentence begins nothing
        ("----", 0, [0]),
        ("tttt", 4, [4]),
        ("m", 0, [0]),
    ],
)
def test_writings(spark, flags, split, starts):
    names = [F.col(c) for c in ("tagged", "caption", "author", "opens", "separate")]
    assert [tuple(r)[1:] for r in writings.writings(made(spark, flags), ["k"], "i", *names).collect()] == [(split, starts)]
    assert writings.writings(made(spark, flags).limit(0), ["k"], "i", *names).count() == 0


def test_notes_find_their_writing():
    marks, pages = [["1", "2"], ["1"], []], [[1, 2], [2, 3], [4]]
    assert writings.owners(marks, pages, [("1", 1), ("2", 2), ("1", 2)]) == [0, 0, 1]
    assert writings.owners(marks, pages, [("1", 1), ("1", 1)]) == [0, 0]  # never past the writings of its page
    assert writings.owners(marks, pages, [("9", 3), (None, None), ("1", 9)]) == [1, 1, 1]
    assert writings.owners([], [], []) == []


def test_syllabus_and_citations(spark):
    body = spark.createDataFrame([(1, i, b, h, c) for i, (b, h, c) in enumerate([(True, False, True), (True, True, False), (False, False, False), (False, False, True), (False, False, False)])] + [(2, 0, True, True, False)], "k int, i long, b boolean, h boolean, c boolean")
    out = writings.syllabus(body, ["k"], "i", F.lit(5).cast("long"), F.col("b"), F.col("h"), F.col("c"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, 3), (2, 1, 5)]
    lines = spark.createDataFrame([(1, 0, 1, 1), (1, 1, 1, 1), (1, 2, None, None), (1, 3, 1, 2), (1, 4, 3, 3), (1, 5, 3, 3)], "k int, i long, a int, z int")
    found = writings.citations(lines, ["k"], "i", F.col("i") < 5, F.col("a"), F.col("z"), F.lit(True), F.lit(True))
    assert sorted(r["i"] for r in found.collect()) == [0, 1, 2, 3]


def test_kinds_and_page_table(spark):
    seen = spark.createDataFrame([(1, 0, "title"), (1, 1, "list"), (1, 2, "list"), (2, 1, "b"), (2, 0, "a"), (3, 0, None)], "g int, r int, kind string")
    assert sorted(tuple(r) for r in writings.kinds(seen, ["g"], "r", "kind").collect()) == [(1, "list"), (2, "a"), (3, "paragraph")]
    pages = spark.createDataFrame([(1, 1, ""), (1, 2, "unread")], "k int, page int, error string")
    groups = spark.createDataFrame([(1, 1, 2, "foot", None, "body"), (1, 1, 1, "head", "A", "body"), (1, 1, 3, "head", "B", "footnotes"), (1, 1, 4, None, "C", "body")], "k int, page int, id int, band string, text string, section string")
    printed = spark.createDataFrame([(1, 1, "ix")], "k int, page int, printed string")
    out = [(r.page, r.printed, r.error, [tuple(f) for f in r.furniture]) for r in writings.page_table(pages, groups, printed, ["k"], "page").orderBy("page").collect()]
    assert out == [(1, "ix", None, [("head", "A"), ("foot", "")]), (2, None, "unread", [])]


def slowly(some):
    groups = [tuple(b) for b in some]
    while True:
        hit = next(((i, j) for i in range(len(groups)) for j in range(i) if all(groups[i][k] <= groups[j][k + 2] and groups[j][k] <= groups[i][k + 2] for k in (0, 1))), None)
        if hit is None:
            return sorted(groups, key=lambda b: (b[1], b[0]))
        a, b = groups.pop(hit[0]), groups.pop(hit[1])
        groups.append(matching.joined(a, b))


def test_touching_boxes_against_a_slow_version():
    rng = random.Random(5)
    for _ in range(200):
        some = [(x, y, x + rng.randint(0, 4), y + rng.randint(0, 4)) for x, y in ((rng.randint(0, 20), rng.randint(0, 20)) for _ in range(rng.randint(0, 12)))]
        assert matching.touching(some) == slowly(some)


def test_blocks_take_the_first_that_fits():
    cells = [(0, 0, 10, 5), (0, 8, 10, 12), (0, 30, 10, 35), (20, 1, 30, 4), (9, 13, 21, 15), (0, 14, 10, 16)]
    assert matching.blocks(cells, [None] * 6, 5) == [0, 0, 2, 1, 0, 0]
    assert matching.blocks(cells, [0, 1, 0, 0, 1, 1], 5) == [0, 2, 3, 1, 2, 2]
    assert matching.blocks([], [], 5) == []


def test_edges_and_text_boxes(spark):
    rows = [(0.1, 0.5, 0.48, 0.9, 0.47, 0.52), (0.1, 0.5, 0.48, 0.9, None, None), (0.1, 0.4, 0.5, 0.9, None, None), (0.1, 0.46, 0.53, 0.9, 0.47, 0.52), (0.1, 0.1, 0.4, 0.9, 0.2, 0.3), (0.1, 0.5, 0.48, 0.9, 0.15, 0.2)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, c double, d double, e double, f double")
    got = df.select("i", boxes.inner_edges((F.col("a"), F.col("b")), (F.col("c"), F.col("d")), (F.col("e"), F.col("f")), 0.01).alias("s")).orderBy("i").collect()
    assert [r.s and (round(r.s.left, 4), round(r.s.right, 4)) for r in got] == [(0.47, 0.52), (0.48, 0.5), None, None, None, (0.48, 0.5)]
    cells = spark.createDataFrame([([(-5.0, 10.0, 50.0, 20.0), (10.0, 5.0, 120.0, 30.0)],), ([],), (None,)], "cells array<struct<x0:double,y0:double,x1:double,y1:double>>")
    box = boxes.text_box(F.col("cells"), (F.lit(100.0), F.lit(100.0)), (F.lit(200.0), F.lit(400.0)))
    assert [r[0] and tuple(r[0]) for r in cells.select(box).collect()] == [(0.0, 20.0, 200.0, 120.0), None, None]


def unit(rank, box, text, kind=None):
    return rank, "abc"[rank], tuple(float(v) for v in box), text, kind


def test_a_page_is_ordered_and_voted():
    left, right, top, note = (40, 100, 280, 130), (320, 100, 560, 130), (40, 20, 560, 40), (40, 700, 280, 730)
    more = [unit(r, b, t) for r in range(3) for b, t in (((40, 200, 280, 230), "Low left"), ((320, 200, 560, 230), "Low right"))]
    units = [
        *more,
        *(unit(r, right, "Right text", "heading" if r == 0 else "list_item") for r in range(3)),
        *(unit(r, left, t) for r, t in enumerate(["Left text", "Left text", "Lift text"])),
        unit(0, top, "Head"), unit(1, top, "Head"),
        unit(2, note, "1 A note"),
        unit(0, (300, 500, 310, 510), "  "),
    ]
    got = pages.page_groups(units, 600.0, 800.0, [(0.0, 690.0, 600.0, 760.0)])
    assert [(g["band"], g["side"], g["text"], g["status"], g["level"], g["readers"]) for g in got] == [
        ("head", None, "Head", "unanimous", "none", "a,b"),
        ("body", "left", "Left text", "majority", "warning", "a,b,c"),
        ("body", "left", "Low left", "unanimous", "none", "a,b,c"),
        ("body", "right", "Right text", "unanimous", "none", "a,b,c"),
        ("body", "right", "Low right", "unanimous", "none", "a,b,c"),
        ("footnotes", "left", "1 A note", "single", "blocking", "c"),
    ]
    assert [g["kind"] for g in got][3] == "list_item" and [g["id"] for g in got] == list(range(6))
    assert [(g["start"], g["end"]) for g in got if g["section"] == "footnotes"] == [(0, 8)] and got[1]["start"] == len("Head") + 2
    assert pages.page_groups([], 600.0, 800.0, []) == []


def test_a_block_over_the_zone_does_not_take_its_notes():
    zone = (0.0, 100.0, 100.0, 200.0)
    units = [("a", (0.0, 0.0, 100.0, 160.0), "body and note"), ("b", (0.0, 0.0, 100.0, 90.0), "body"), ("b", (0.0, 110.0, 100.0, 160.0), "note")]
    assert sorted(map(sorted, consensus.align_page(units))) != sorted(map(sorted, consensus.align_page(units, zones=[zone])))
    assert sorted(map(sorted, consensus.align_page(units, zones=[zone])))[-1] == [2]


def test_open_places_and_items():
    assert consensus.open_places(["the cat sat", "the cot sat", "the cut sat"]) == [("cat", ["cat", "cot", "cut"])]
    assert consensus.open_places(["the cat", "the cat", "the cot"]) == [] and consensus.open_places([None, "x"]) == []
    text = "Held: 1. One thing 2. Two things"
    assert consensus.item_starts(text, [(text, [6, 19]), ("Held: 1. One thing 2. Too things", [6]), ("1. One", [0])], 2) == [6]
    assert consensus.item_starts("", [("a", [0])], 1) == []


def test_built_pages_and_documents(spark):
    heads = spark.createDataFrame([(1, p, r, k, w, 800.0, e) for p, r, k, w, e in [(1, "a", 0, 600.0, None), (1, "b", 1, None, None), (1, "c", 2, 600.0, "timed out"), (2, "a", 0, None, None), (3, "a", 0, 600.0, "gone"), (4, "a", 0, 600.0, None)]], "doc int, page int, reader string, rank int, width double, height double, error string")
    units = spark.createDataFrame([(1, 1, r, k, 40.0, y, 280.0, y + 30, t, None) for r, k, y, t in [("a", 0, 100.0, "One text"), ("b", 1, 101.0, "One text"), ("c", 2, 100.0, "Not this"), ("a", 0, 700.0, "A note")]] + [(1, 4, "a", 0, 1.0, 100.0, 9.0, 120.0, "Last", "heading")], "doc int, page int, reader string, rank int, x0 double, y0 double, x1 double, y1 double, text string, kind string")
    zones = spark.createDataFrame([(1, 1, 0.0, 690.0, 600.0, 790.0)], "doc int, page int, x0 double, y0 double, x1 double, y1 double")
    out = pages.built(heads, units, zones, ["doc", "page"])
    assert sorted((r.page, r.id, r.section, r.text, r.missing, r.error) for r in out.where("page <> 2 AND page <> 3").collect()) == [(1, 0, "body", "One text", "c", None), (1, 1, "footnotes", "A note", "c", None), (4, 0, "body", "Last", "", None)]
    assert sorted((r.page, r.id, r.missing, r.error) for r in out.where("page IN (2, 3)").collect()) == [(2, None, "", pages.UNMEASURED), (3, None, "a", "gone")]
    assert [tuple(r) for r in pages.documents(out, ["doc"], "page").collect()] == [(1, "One text\n\nLast", "A note", 3, 2, 0)]
    assert pages.built(heads.limit(0), units.limit(0), zones.limit(0), ["doc", "page"]).count() == 0


def test_role_words(spark):
    rows = [
        (1, 0, "ON PETITION  FOR REHEARING", True, None), (1, 1, "Andrews, J. (dissenting). Assisting a passenger.", False, 10), (1, 2, "Text.", False, None),
        (2, 0, "Text", False, None), (2, 1, "Ciklin, J.,", False, 10), (2, 2, "I respectfully concur with Ch. J. Roe; and more.", False, None),
        (3, 0, "Roe, J. We concur with the court.", False, 6), (4, 0, None, False, None), (4, 1, "Dissented. x", None, 0), (5, 0, "A" * 400, False, 0),
    ]
    df = spark.createDataFrame(rows, "k int, i int, text string, heading boolean, end int")
    got = {(r["k"], r["i"]): r["role_words"] for r in writings.role_words(df, ["k"], "i", F.col("text"), F.col("heading"), F.col("end")).collect()}
    assert got[1, 1] == "on petition for rehearing andrews, j (dissenting)." and got[2, 1] == "ciklin, j. i respectfully concur with ch. j. roe;"
    assert got[3, 0] == "roe, j" and got[4, 0] == "dissented." and got[4, 1] == "dissented." and got[5, 0] == "" and got[1, 0] == ""
