"""Operators on rows made by hand: empty input, ties, nulls and boundary values."""

import random

import pytest
from pyspark.sql import functions as F

from leafline.functions import compare, reasons, scalars
from leafline.operators import consensus, markup, matching, relational, sequences, structure
from leafline.sources import tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_as_of_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, 10), (1, 5), (2, 10), (None, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 5, 7), (1, 9, 8), (1, 11, 9), (2, 11, 1)], "k int, t int, v int")
    got = relational.as_of(left, right, ["k"], "t", ["v"]).select("k", "t", "matched_v")
    assert sorted(rows(got), key=str) == sorted([(1, 10, 8), (1, 5, 7), (2, 10, None), (None, 1, None)], key=str)
    assert relational.as_of(left.limit(0), right, ["k"], "t", ["v"]).count() == 0


def test_point_in_interval_is_inclusive(spark):
    points = spark.createDataFrame([(0,), (10,), (11,), (130,)], "p int")
    spans = spark.createDataFrame([(1, 0, 10), (2, 10, 130), (3, 12, 11)], "i int, lo int, hi int").where("lo <= hi")
    assert rows(relational.point_in_interval(points, spans, "p", "lo", "hi", width=8).select("p", "i")) == [(0, 1), (10, 1), (10, 2), (11, 2), (130, 2)]


def test_whole_groups_takes_the_first_even_if_too_large(spark):
    groups = spark.createDataFrame([(1, 9), (2, 1), (3, 1)], "g int, n long")
    assert rows(relational.whole_groups(groups, "g", 5).select("g")) == [(1,)]
    assert rows(relational.whole_groups(groups, "g", 10).select("g")) == [(1,), (2,)]
    assert relational.whole_groups(groups.limit(0), "g", 5).count() == 0


def test_over_cap_admit_latest_and_same_source(spark):
    ten = spark.range(10)
    assert relational.over_cap(ten, 9) and not relational.over_cap(ten, 10)
    work = spark.createDataFrame([(1, "a", "p"), (2, "a", "p"), (3, "a", "f"), (4, "b", "p")], "i int, g string, s string")
    assert rows(relational.admit(work, "g", F.col("s") == "p", F.col("s") == "f", 2, "i").select("i")) == [(1,), (4,)]
    runs = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, None)], "k int, run int, v string")
    assert rows(relational.latest(runs, ["k"], "run").select("k", "v")) == [(1, "y"), (2, None)]
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("", "b"), ("a", "")], "a string, b string")
    assert pairs.where(relational.same_source(F.col("a"), F.col("b"))).count() == 3


def test_card_states(spark):
    stored = spark.createDataFrame([(1, "open", False, "x"), (2, "answered", False, "x"), (3, "applied", False, "x"), (4, "applied", True, "x"), (5, "open", False, "x"), (6, "applied", False, "x")], "k int, status string, minor boolean, readings string")
    fresh = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "x"), (7, "x")], "k int, readings string")
    assert rows(relational.card_state(stored, fresh, ["k"])) == [(1, "keep"), (2, "stale"), (3, "reopen"), (4, "keep"), (5, "delete"), (6, "keep"), (7, "create")]


def test_islands_join_over_range_ends(spark):
    values = spark.createDataFrame([(v,) for v in [1, 2, 4, 65535, 65536, 65537, 65537]], "v long")
    assert rows(sequences.islands(values, "v")) == [(1, 2, 2), (4, 4, 1), (65535, 65537, 3)]
    assert sequences.islands(values.limit(0), "v").count() == 0


def test_coverage_gaps(spark):
    bounds = spark.createDataFrame([(1, 1, 6), (2, None, 5), (3, 1, 3)], "k int, first int, last int")
    spans = spark.createDataFrame([(1, 2, 3), (1, 5, 5), (2, 1, 1)], "k int, start int, end int")
    assert rows(sequences.coverage_gaps(bounds, spans, "k")) == [(1, 1, 1, 1), (1, 4, 4, 1), (1, 6, 6, 1)]


def test_sequence_checks(spark):
    pages = spark.createDataFrame([(1, k, v) for k, v in enumerate([4, 6, 6, 5, 20])], "k int, o int, n int")
    assert set(rows(sequences.sequence_checks(pages, ["k"], "o", "n"))) == {(1, "large_gap", 7, 19), (1, "duplicate", 6, 6), (1, "backward", 5, 5)}


def test_neighbours_read_original_values(spark):
    pages = spark.createDataFrame([(1, k, v, [11, 12, 13]) for k, v in enumerate([10, 99, 12, 99, 14])], "k int, o int, v int, c array<int>")
    assert [r[-1] for r in rows(sequences.by_neighbours(pages, ["k"], "o", "v", "c"), "o")] == [10, 11, 12, 13, 14]


def test_interpolation_rounds_half_to_even(spark):
    pages = spark.createDataFrame([(1, 0, 2), (1, 1, None), (1, 2, 7), (1, 3, None)], "k int, o int, v int")
    assert [r[-1] for r in rows(sequences.interpolate(pages, ["k"], "o", "v"), "o")] == [5, 4, 4, 8]


@pytest.mark.parametrize(("pages", "size", "want"), [(1, 10**9, 1), (250, 0, 3), (10, 1000, 10), (100, 450, 5)])
def test_shard_plan(spark, pages, size, want):
    got = rows(sequences.plan_shards(spark.createDataFrame([(pages, size)], "p long, s long"), "p", "s", 100, 100).select("first_page", "last_page"))
    assert len(got) == want and got[0][0] == 0 and got[-1][1] == pages - 1
    assert all(b[0] == a[1] + 1 for a, b in zip(got, got[1:]))


def test_slot_order(spark):
    pages = spark.createDataFrame([(1, p) for p in range(4)], "k int, p long")
    edits = spark.createDataFrame([(1, 1, "delete", None), (1, 0, "move", 2), (1, 9, "insert", 3)], "k int, p long, kind string, target long")
    assert [r[1] for r in rows(sequences.slot_order(pages, edits, "k", "p"), "final")] == [2, 0, 3, None]


def test_moved_pages_land_before_inserts_and_the_stronger_edit_wins(spark):
    pages = spark.createDataFrame([(1, p) for p in range(1, 5)], "k int, p long")
    edits = [(1, 1, "move", 3, None, None), (1, 0, "insert", 3, 2, None), (1, 2, "replace", None, 2, None), (1, 2, "rotate", None, None, 90), (1, 4, "rotate", None, None, 180), (1, 4, "move", 0, None, None), (1, 3, "move", 9, None, None), (1, 3, "delete", None, None, None)]
    out = sequences.slot_order(pages, spark.createDataFrame(edits, "k int, p long, kind string, target long, count int, turn int"), "k", "p")
    assert [tuple(r)[1:5] for r in out.orderBy("final").collect()] == [(4, "rotate", 0, 180), (2, "replace", 0, None), (2, "replace", 1, None), (1, "original", 0, None), (None, "insert", 0, None), (None, "insert", 1, None)]


def test_printed_spans(spark):
    numbers = spark.createDataFrame([(1, 0, 10, None), (1, 1, 11, 12), (1, 3, 14, 15), (1, 5, 3, None)], "k int, page int, low int, high int")
    bounds = spark.createDataFrame([(1, 1, 1), (1, 1, 3), (1, 1, 4), (1, 1, 2), (1, 2, 3), (1, 3, 5), (2, 1, 1), (None, 1, 1)], "k int, start int, end int")
    out = {tuple(r)[:3]: tuple(r)[3:] for r in sequences.printed_spans(bounds, numbers, "k").collect()}
    assert out == {(1, 1, 1): (11, 12, None), (1, 1, 3): (12, 14, None), (1, 1, 4): (12, 14, None), (1, 1, 2): (12, 12, None), (1, 2, 3): (None, None, "no_number"), (1, 3, 5): (None, None, "backwards"), (2, 1, 1): (None, None, "no_number"), (None, 1, 1): (None, None, "no_number")}
    assert sequences.printed_spans(bounds.limit(0), numbers, "k").count() == 0


def test_greedy_orders_differ(spark):
    pairs = spark.createDataFrame([("p", 1, 1, 0.6), ("p", 1, 2, 0.6), ("p", 2, 1, 0.9)], "k string, a long, b long, s double")
    assert rows(matching.greedy_by_row(pairs, ["k"], "a", "b", "s")) == [("p", 1, 1, 0.6)]
    assert rows(matching.greedy_by_row(pairs, ["k"], "a", "b", "s", last_of_equal=True)) == [("p", 1, 2, 0.6), ("p", 2, 1, 0.9)]
    assert rows(matching.greedy_by_score(pairs, ["k"], "a", "b", "s")) == [("p", 1, 2, 0.6), ("p", 2, 1, 0.9)]


def test_overlaps_are_found_once_over_cells(spark):
    a = spark.createDataFrame([("p", 1, 0.0, 0.0, 10.0, 1.0), ("p", 2, 10.0, 0.0, 12.0, 1.0)], "k string, i int, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame([("p", 7, 1.0, 0.5, 9.0, 2.0), ("q", 8, 1.0, 0.5, 9.0, 2.0)], a.schema)
    assert rows(matching.overlapping(a, b, ["k"], size=2.0).select("a_i", "b_i")) == [(1, 7)]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("12-15",), ("7b",), ("9",), ("15-12",), ("1-900",), ("x",), (None,)], "t string")
    got = [tuple(r) for r in df.select("t", scalars.number_type(F.col("t")), scalars.page_span(F.col("t"))).collect()]
    assert [(g[1], g[2] and tuple(g[2])) for g in got] == [("range", (12, 15)), ("suffixed", (7, 7)), ("single", (9, 9)), ("range", None), ("range", None), (None, None), (None, None)]
    df = spark.createDataFrame([("[16-19]",), ("[1, 2]",), ("[0-2]",), ("[9-3]",), ("no",)], "t string")
    assert [r[0] for r in df.select(scalars.expand_brackets(F.col("t"))).collect()] == [[16, 17, 18, 19], [1, 2], [1, 2], [], []]
    df = spark.createDataFrame([("“A.  B.”  ﬁn — *x*",), (None,)], "t string")
    assert [r[0] for r in df.select(scalars.compare_text("t")).collect()] == ['"A.B." finx', None]
    df = spark.createDataFrame([("*12 [3] text",), ("801 General",), ("1 x",), ("[4, 5] held",), ("(C) Y",)], "t string")
    assert [r[0] for r in df.select(scalars.strip_star("t")).collect()] == ["text", "General", "1 x", "held", "(C) Y"]


@pytest.mark.parametrize(("text", "want"), [("131 L. Ed. 2d 490", "131 L.Ed.2d 490"), ("another . . . ,", "another...,"), ("S.D.N. Y.", "S.D.N.Y."), ("¶ 8 and § 1983", "¶8 and §1983"), ("Mohort-er", "Mohorter"), ("12-345", "12-345"), ("677 -- 679", "677-679"), ("CP-23-CR-0001065- 2021", "CP-23CR-0001065-2021"), ("express[ ]", "express[]"), ("“ ‘finally", "\"'finally"), ("A. Smith", "A. Smith"), ("## FACTS", "FACTS"), ("###", ""), ("F. App’x,", "F.App'x,")])
def test_compared_forms(text, want):
    assert compare.key_of(text) == want.replace("CP-23CR", "CP-23-CR")


@pytest.mark.parametrize(
    ("readings", "want"),
    [
        (["a"], "single_short"), (["a b c d"], "single_long"), (["a", "a"], "spacing"), (["a b", "ab"], "spacing"), (["it’s", "it's"], "quotes"), (["well-known", "wellknown"], "spacing"), (["a, b", "a b"], "punctuation"), (["Abc", "abc"], "capitals"),
        (["¶10", "¶ 10", "¶0"], "spacing"), (["*12 held", "held"], "star_mark"), (["", ""], "spacing"), (["abc", None], "words_short"), (["not so", ""], "meaning_word"), (["17", ""], "star_mark"), (["page 17", ""], "numbers"), (["a bc de", ""], "words_long"),
        (["the cat sat", "the cot sat"], "characters"), (["the Cat sat", "the Cot sat"], "name"), (["the cat sat", "the dog sat"], "different_word"), (["he may go", "he can go"], "meaning_word"), (["in 1983 x", "in 1984 x"], "numbers"), (["a quick brown fox", "xyz lmno pqrs tuv"], "different_text"),
        (["the old cat", "the cat"], "words_short"), (["one two a b c", "one two"], "words_long"), (["Tal lahassec", "Tallahassee"], "name"), (["tal lahassec", "tallahassee"], "characters"),
    ],
)
def test_reasons(readings, want):
    assert reasons.reason_of(readings) == want and want in reasons.REASONS


def test_places_that_need_no_person():
    assert reasons.needs_no_person(["held,", "held.", "hold;"], "held") and not reasons.needs_no_person(["held,", "held.", "hold;"], "hold;")
    assert not reasons.needs_no_person(["cat", "dog"], "cat") and not reasons.needs_no_person(["cat"], "cat")


def test_json_repair():
    assert scalars.repair('{"a": 1') == '{"a": 1}'
    assert scalars.repair('{"a": 1}}') == '{"a": 1}'
    assert scalars.repair('{"a": [1, 2}') is None or scalars.repair('{"a": [1, 2}')
    assert scalars.repair(None) is None and scalars.repair("nothing") is None


def test_votes():
    assert consensus.resolve(["a b", "a b", "a c"]).status == "majority"
    assert consensus.resolve(["a b", None, ""]).status == "single"
    assert consensus.resolve(["###", None]).status == "nothing_read" and consensus.resolve([]).status == "nothing_read"
    assert (consensus.resolve(["“x” – y", '"x" - y', "“x”—y"]).status, consensus.resolve(["Mohort-er", "Mohorter"]).text) == ("unanimous", "Mohorter")
    assert consensus.resolve(["self-defense", "selfdefense", "self-defense"]).text == "self-defense"
    got = consensus.resolve(["the cat sat", "the cat sit", "a cat sat"])
    assert (got.status, got.text, got.open_words) == ("voted", "the cat sat", 0) and [t.majority for t in got.tokens] == [True, False, True]
    got = consensus.resolve(["x y", "x z", "x w"])
    assert (got.text, got.open_words) == ("x y", 1) and [t.low for t in got.tokens] == [False, True]
    # a run that one of three readers puts in is dropped, and where none agree the gap blocks
    assert [t.gap for t in consensus.resolve(["a c", "a b c", "b c"]).tokens] == ["", "warning"]
    got = consensus.resolve(["a c e", "a b c e", "a d c f"])
    assert (got.text, got.open_words) == ("a c e", 1) and [t.gap for t in got.tokens] == ["", "blocking", ""]
    # with two readers every difference is a tie, which stays as low words
    got = consensus.resolve(["a c", "a b c"])
    assert (got.text, got.open_words) == ("a b c", 1) and [t.low and t.inserted for t in got.tokens] == [False, True, False]
    # two readers that join what the first splits take it whole, and its rest goes
    assert consensus.resolve(["see ab cd and x", "see abcd and y", "see abcd and z"]).text == "see abcd and x"
    # a joined span that loses leaves the base's words
    assert consensus.resolve(["see ¶ 235 and x", "see ¶ 235 and y", "see P235 and z"]).text == "see ¶ 235 and x"


def test_settled_places_vote_alike(spark):
    texts = [["a b", "a b", "a c"], ["a", "", ""], ["", "", ""], ["x.", "x.", "x."], ["a b", "a c", "b c"], ["A. B", "A.B", "A.B"], ["“q”", '"q"', "q"], [None, "a  b", " a b"], ["No. 2d", "No. 2d", "x"], ["?", "?", "a"]]
    df = spark.createDataFrame([(k, r, t) for k, ts in enumerate(texts) for r, t in enumerate(ts)], "k int, reader int, text string")
    got = {r["k"]: (r["text"], r["status"], r["open_words"]) for r in consensus.consensus(df, ["k"], "reader", "text").collect()}
    want = {k: (v.text, v.status, v.open_words) for k, v in enumerate(map(consensus.resolve, texts))}
    assert got == want
    held = {r["k"]: r["status"] for r in consensus.settled(consensus.gathered(df, ["k"], "reader", "text")).collect()}
    assert [k for k, v in held.items() if v is None and want[k][1] != "voted"] and held[0] == "majority" and held[2] == "nothing_read"


def test_alignment_and_order():
    a, b = (0.0, 0.0, 10.0, 2.0), (0.0, 3.0, 10.0, 5.0)
    units = [("r", a, "x"), ("s", a, "x"), ("r", b, "y"), ("s", (0.0, 0.0, 10.0, 5.0), "x y"), ("t", b, ""), ("t", (50.0, 50.0, 51.0, 51.0), "")]
    assert sorted(map(sorted, consensus.align_page(units))) == [[0, 1], [2, 4], [5]]
    columns = [(300.0, 10.0, 550.0, 20.0), (20.0, 10.0, 280.0, 20.0), (300.0, 40.0, 550.0, 50.0), (20.0, 40.0, 280.0, 50.0), (20.0, 30.0, 550.0, 35.0)]
    assert consensus.reading_order(columns, 600.0) == [1, 0, 4, 3, 2]
    assert consensus.column_boundary(columns[:3], 600.0) is None


def test_markup_round_trip():
    made = random.Random(5)
    for _ in range(200):
        text = " ".join("".join(made.choice("ab<&é") for _ in range(made.randint(1, 6))) for _ in range(made.randint(1, 8)))
        words = [(i, i + len(w)) for w in [text.split()[0]] for i in [0]]
        marks = sorted({(*made.choice(words), made.choice(["bold", "italic", "sup"])) for _ in range(2)})
        back = markup.parse_html(markup.serialize(text, marks))
        assert (back.text, markup.merge_marks(back.marks)) == (text, marks)
    assert markup.parse_html(None).text == ""
    assert markup.parse_markdown("# A **b _c_**\n- d").text == "A b c\nd"
    assert markup.parse_html("<table><tr><td>a</td><td>b</td></tr></table>").tables == [[["a", "b"]]]


def test_projection_maps_back():
    text = "a won-\nder and\nwell-\nKnown"
    flat, places = markup.project(text)
    assert flat == "a wonder and well- Known"
    s, e = markup.lift_span(places, 2, 8)
    assert text[s:e] == "won-\nder"


def test_structure(spark):
    lines = spark.createDataFrame([(1, 0, "It goes"), (1, 1, "on here."), (1, 2, "New one-"), (1, 3, "Half")], "d int, n int, t string")
    assert [r[-1] for r in rows(structure.paragraphs(lines, ["d"], "n", "t"), "paragraph")] == ["It goes on here.", "New one- Half"]
    assert structure.accepted_labels(["1 a", "9 b", "[2] c", "d"]) == [1, None, 2, None]
    assert structure.footnotes(["1 a", "more", "2. b"]) == [(1, ["a", "more"]), (2, ["b"])]
    assert structure.repair_spans("The court, holds", [(5, 7, "x"), (11, 12, "x")]) == [(4, 16, "x")]
    words = [(0, 1, "a"), (2, 3, "b"), (4, 5, "c")]
    assert structure.decode_tags(words, ["B-x", "I-x", "O"]) == [(0, 3, "x")]
    assert structure.encode_tags(words, [(0, 3, "x")]) == ["B-x", "I-x", "O"]
    assert structure.heal([(0, 1, "d"), (2, 3, "e"), (4, 5, "d")], [(0, 9)], "d") == [(0, 5, "d")]
    assert structure.windows(10, 4, 1) == [(0, 4), (3, 7), (6, 10)] and structure.windows(0, 4, 1) == []
    import xml.etree.ElementTree as ET

    assert ET.fromstring(structure.to_xml("1", "a & b", [("x < y", [(0, 1, "s")])], [(1, ["n"])])).find("p/span").text == "x"


def test_sources(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"schema": 2,\n "v": 1}')
    assert tables.read_json_document(spark, str(tmp_path / "d.json"), "schema int, v int", 2).first()["v"] == 1
    with pytest.raises(Exception, match="schema version"):
        tables.read_json_document(spark, str(tmp_path / "d.json"), "schema int, v int", 3).collect()
    parts = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 5, 9)], "r int, p int, f int, l int")
    assert tables.read_parts(parts, ["r"], "p", "f", "l").count() == 2
    with pytest.raises(Exception, match="part numbers"):
        tables.read_parts(parts.where("p = 1"), ["r"], "p", "f", "l").collect()
    out = str(tmp_path / "sets")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    tables.replace_sets(df, out, ["k"])
    tables.replace_sets(spark.createDataFrame([(1, "c")], "k int, v string"), out, ["k"])
    assert sorted(r["v"] for r in spark.read.parquet(out).collect()) == ["b", "c"]
    assert tables.list_objects(spark, out).count() >= 2
    assert rows(tables.upsert(df, spark.createDataFrame([(2, "z"), (3, "n")], "k int, v string"), ["k"], ["v"])) == [(1, "a", "stale"), (2, "z", "match"), (3, "n", "new")]
    assert [r["k"] for r in tables.fetch_in_order(df, "k", [2, 1]).collect()] == [2, 1]


def test_queue_file(spark, tmp_path):
    path = tmp_path / "queue.tsv"
    path.write_text("Slug\tVolume #\tPart\tStatus\tFirst Page\tLast Page\tLocated\nU\t1\tA\tDone\t10\t20\tshelf\nU\t1\tB\tin progress\t1\t\tbox\nU\t2\t\t\tx\t9\t\n\t3\t\tdone\t1\t2\t\n")
    got = rows(tables.read_queue_csv(spark, str(path)), "volume")
    assert got == [("U", "1", 1, 20, 2, True, "complete", "shelf"), ("U", "2", None, 9, 1, False, "waiting", None)]


def test_json_lines_and_results(spark, tmp_path):
    path = tmp_path / "out.jsonl"
    path.write_text('{"action": "read", "item": 4, "schema": 2, "page": 1}\n{"action": "read", "item": 4, "schema": 2, "page": 2}\n')
    df = tables.read_json_lines(spark, str(path), "action string, item int, schema int, page int")
    assert rows(tables.checked_results(df, "read", 4, 2).select("page")) == [(1,), (2,)]
    for action, item, version in (("write", 4, 2), ("read", 5, 2), ("read", 4, 1)):
        with pytest.raises(Exception, match="unexpected"):
            tables.checked_results(df, action, item, version).collect()
    tables.write_documents(df.select(F.col("page").cast("string").alias("t")), str(tmp_path / "sink"), "t")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "sink")).collect()) == ["1", "2"]


def test_islands_across_ranges(spark):
    values = [*range(65530, 65540), *range(2 * 65536 - 3, 2 * 65536), *range(3 * 65536, 5 * 65536 + 2), 7, 9, 10]
    got = rows(sequences.islands(spark.createDataFrame([(v,) for v in values], "v long"), "v"))
    assert got == [(7, 7, 1), (9, 10, 2), (65530, 65539, 10), (131069, 131071, 3), (196608, 327681, 131074)]


def test_request_filters():
    from leafline.operators import review

    with pytest.raises(ValueError, match="no filter"):
        review.request_filters({"drop": 1}, {})
    assert review.request_filters({"a": "", "b": None}, {"a": "a =", "b": "b ="}) == []


def test_marks_and_words_without_a_test_so_far(spark):
    from leafline.functions import boxes

    df = spark.createDataFrame([("A. b-C 1",)], "t string")
    assert df.select(scalars.bare(F.col("t")), scalars.heading_words(F.col("t"))).first() == ("AbC1", "a b c")
    b = tuple(F.lit(v) for v in (-4.0, 2.0, 16.0, 10.0))
    got = df.select(*boxes.core(b), *boxes.clamp(b, F.lit(10.0), F.lit(8.0)), boxes.to_points(F.lit(100.0), F.lit(200.0))).first()
    assert tuple(got) == (-1.0, 4.0, 13.0, 8.0, 0.0, 2.0, 10.0, 8.0, 36.0)
    assert consensus.level("voted", "x", 2) == "blocking" and consensus.level("voted", "x", 2, minor=True) == "warning" and consensus.level("single", "x", 0) == "blocking" and consensus.level("unanimous", "x", 0) == "none"
    rows_ = spark.createDataFrame([(1, None), (2, True), (3, False)], "i int, b boolean")
    assert rows(rows_.where(relational.none_of(F.col("b"))).select("i")) == [(1,), (3,)]
