"""Queries of measures, text flow, markup and votes, and their SQL."""

from __future__ import annotations

import re
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafline.functions import compare, reasons, scalars
from leafline.operators import consensus, markup, structure, tables
from leafline.operators import marks as marked
from leafline.plans.registry import registry
from leafline.sources.tables import load
from leafline.streaming import streams

QUERIES, ORACLE_SQL, query = registry()


@query("SELECT doc_id, n_chars - median(n_chars) OVER (PARTITION BY source, doc_id % 2) AS relative FROM documents")
def q23_relative_measure(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "n_chars", "source", (F.col("doc_id") % 2).alias("side"))
    # medians are made once a group and joined, so a large group is not one window
    medians = docs.groupBy(F.col("source").alias("m_source"), F.col("side").alias("m_side")).agg(F.median("n_chars").alias("m"))
    return docs.join(medians, [F.col("source").eqNullSafe(F.col("m_source")), F.col("side").eqNullSafe(F.col("m_side"))]).select("doc_id", (F.col("n_chars") - F.col("m")).alias("relative"))


@query("""
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, median(value) AS m FROM events GROUP BY 1, 2 HAVING count(*) >= 3),
s AS (SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS med, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1)
SELECT event_type, p10, med, p90, round(max(m) - min(m), 6) AS spread FROM s JOIN d USING (event_type) GROUP BY ALL""")
def q24_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")
    days = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.median("value").alias("m")).where("n >= 3")
    spread = days.groupBy("event_type").agg(F.round(F.max("m") - F.min("m"), 6).alias("spread"))
    p = events.groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"))
    return p.join(spread, "event_type").select("event_type", *(F.round(F.col("p")[k], 6).alias(c) for k, c in enumerate(("p10", "med", "p90"))), "spread")


@query(r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l),
f AS (SELECT *, CASE WHEN before IS NOT NULL AND (regexp_matches(before, '-\s*$') OR regexp_matches(line, '^\s*[a-z]') OR NOT regexp_matches(before, '[.!?:;]["'')\]]*\s*$')) THEN 0 ELSE 1 END AS fresh FROM b),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS paragraph FROM f)
SELECT doc_id, CAST(paragraph AS BIGINT) AS paragraph, count(*) AS lines, md5(string_agg(line, ' ' ORDER BY pos)) AS text_md5 FROM p GROUP BY 1, 2""")
def q43_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    out = structure.paragraphs(lines, ["doc_id"], "pos", "line")
    return out.select("doc_id", "paragraph", F.col("lines").cast("long").alias("lines"), F.md5("text").alias("text_md5"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<li[ >]')) AS INTEGER) AS items, CAST(len(regexp_extract_all(html, '<h[1-6][ >]')) AS INTEGER) AS headings, CAST(len(regexp_extract_all(html, '<table[ >]')) AS INTEGER) AS tables FROM pages""")
def q44_markup_counts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", markup.parsed_html("html").alias("p")).select("page_id", "p.items", "p.headings", "p.tables")


@query()
def q44b_markup_text(spark: SparkSession, sf: str) -> DataFrame:
    got = load(spark, sf, "pages").select("page_id", markup.parsed_html("html").alias("p"))
    return got.select("page_id", F.length("p.text").alias("n_chars"), F.size("p.marks").alias("n_marks"), F.sha2("p.text", 256).alias("digest"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '([a-z]{3})([a-z]{3})', '\1-' || chr(10) || '\2') AS cut FROM documents)
SELECT doc_id, md5(regexp_replace(cut, '([a-z])-\n([a-z])', '\1\2', 'g')) AS digest FROM t""")
def q45_dehyphenate(spark: SparkSession, sf: str) -> DataFrame:
    first = F.regexp_extract("text", r"([a-z]{3}[a-z]{3})", 1)
    cut = load(spark, sf, "documents").select("doc_id", "text", first.alias("w"))
    broken = F.when(F.col("w") == "", F.col("text")).otherwise(F.concat(F.expr("substring(text, 1, locate(w, text) + 2)"), F.lit("-\n"), F.expr("substring(text, locate(w, text) + 3)")))
    return cut.select("doc_id", F.md5(scalars.dehyphenate(broken)).alias("digest"))


_READERS = ("a", "b", "c")
_LINE_READINGS = pa.struct([("reader", pa.string()), ("text", pa.string())])


@F.arrow_udf(T.ArrayType(T.StructType().add("reader", T.StringType()).add("text", T.StringType())))
def _noisy(docs: pa.Array, lines: pa.Array, texts: pa.Array) -> pa.Array:
    made: list[str] = []
    for doc, line, text in zip(docs.to_pylist(), lines.to_pylist(), texts.to_pylist(), strict=True):
        words = scalars.split_words(text)
        for reader in _READERS:
            # a digest has a byte for each of sixteen words
            head = "|".join(str(v) for v in (reader, doc, line) if v is not None)
            marks = b"".join([md5(f"{head}|{k}".encode()).digest() for k in range(len(words) // 16 + 1)])
            hits = [m.start() for m in _CHANGED.finditer(marks, 0, len(words))]
            said = words
            if hits:
                said = words.copy()
                for k in reversed(hits):
                    if marks[k] < 4:
                        del said[k]
                    else:
                        said[k] += "x"
            made.append(" ".join(said))
    n = len(_READERS)
    ends = pa.array(range(0, len(made) + 1, n), pa.int32())
    readers = pa.array(_READERS * (len(made) // n), pa.string())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([readers, pa.array(made, pa.string())], fields=list(_LINE_READINGS)))


_CHANGED = re.compile(rb"[\x00-\x07]")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Three readings of each line, with words changed or dropped by a digest of reader, document, line and place.

    Documents are dealt by their key first, as a file with one row group would be one task."""
    docs = load(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.select("doc_id", "line", F.inline(_noisy("doc_id", "line", "t")))


_READINGS = """n AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, list_filter(regexp_split_to_array(trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')), ' '), lambda w: w <> '') AS words FROM documents),
r AS (SELECT doc_id, line, reader, array_to_string(list_filter(list_transform(words, lambda w, i: CASE WHEN substring(md5(concat(reader, '|', doc_id, '|', line, '|', (i - 1) // 16)), 2 * ((i - 1) % 16) + 1, 2) < '04' THEN '' WHEN substring(md5(concat(reader, '|', doc_id, '|', line, '|', (i - 1) // 16)), 2 * ((i - 1) % 16) + 1, 2) < '08' THEN concat(w, 'x') ELSE w END), lambda w: w <> ''), ' ') AS t
 FROM n CROSS JOIN (VALUES ('a'), ('b'), ('c')) v(reader))"""


@query(rf"""WITH {_READINGS}, g AS (SELECT doc_id, line, list(t ORDER BY reader) AS every, list(t ORDER BY reader) FILTER (t <> '') AS said FROM r GROUP BY 1, 2),
p AS (SELECT *, coalesce(len(said), 0) AS n, len(list_filter(every, lambda t: regexp_matches(t, '[^a-zA-Z0-9 .,;:!?()À-ÖØ-öø-ÿ]') OR regexp_matches(t, '\.\s*[0-9.]') OR regexp_matches(concat(' ', t), '[^\pL0-9]\p{{Lu}}\.') OR (t <> '' AND NOT regexp_matches(t, '[\pL0-9]')))) = 0 AS plain FROM g),
b AS (SELECT *, list_filter(said, lambda x: 2 * len(list_filter(said, lambda y: y = x)) > n)[1] AS best FROM p)
SELECT doc_id, line, CASE WHEN NOT plain THEN 'not plain' WHEN n = 0 THEN 'nothing_read' WHEN n = 1 THEN 'single' WHEN len(list_filter(said, lambda y: y = best)) = n THEN 'unanimous' WHEN best IS NOT NULL THEN 'majority' ELSE 'open' END AS status,
 CASE WHEN plain THEN md5(CASE WHEN n = 0 THEN '' ELSE best END) END AS digest FROM b""")
def q46a_settled_places(spark: SparkSession, sf: str) -> DataFrame:
    places = consensus.settled(consensus.gathered(readings(spark, sf), ["doc_id", "line"], "reader", "text"))
    plain = F.forall("readings", lambda r: r.rlike(compare.PLAIN) & r.rlike(r"[\p{L}\d]|^$"))
    return places.select("doc_id", "line", F.when(~plain, "not plain").otherwise(F.coalesce("status", F.lit("open"))).alias("status"), F.when(plain, F.md5("text")).alias("digest"))


@query()
def q46_consensus(spark: SparkSession, sf: str) -> DataFrame:
    out = consensus.consensus(readings(spark, sf), ["doc_id", "line"], "reader", "text")
    return out.select("doc_id", "line", "status", "open_words", F.md5("text").alias("digest"))


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """The readings of each line in the order of their readers."""
    each = readings(spark, sf).groupBy("doc_id", "line").agg(F.array_sort(F.collect_list(F.struct("reader", "text"))).alias("r"))
    return each.select("doc_id", "line", F.transform("r", lambda x: x["text"]).alias("readings"))


@query()
def q47_difference_types(spark: SparkSession, sf: str) -> DataFrame:
    places = _places(spark, sf).withColumn("minor", reasons.minor_reason("readings"))
    kinds = places.withColumn("rest", reasons.reason(F.when(F.col("minor").isNull(), F.col("readings")))).select(F.coalesce("minor", "rest").alias("reason"))
    return kinds.groupBy("reason").count().withColumnRenamed("count", "n")


@query(rf"""WITH {_READINGS}, g AS (SELECT doc_id, line, list(t ORDER BY reader) AS e, any_value(len(list_distinct(list_value(t)))) AS one FROM r GROUP BY 1, 2),
f AS (SELECT e, list_transform(e, lambda t: regexp_replace(t, '\s+', '', 'g')) AS f1, list_transform(e, lambda t: regexp_replace(t, '[\s"''‘’‚‛“”„‟`´]+', '', 'g')) AS f2, list_transform(e, lambda t: regexp_replace(t, '[\s"''‘’‚‛“”„‟`´‐‑‒–—―-]+', '', 'g')) AS f3,
 list_transform(e, lambda t: regexp_replace(t, '[^\pL\pN\pM\p{{Pc}}]', '', 'g')) AS f4, list_transform(e, lambda t: lower(regexp_replace(t, '[^\pL\pN\pM\p{{Pc}}]', '', 'g'))) AS f5 FROM g),
m AS (SELECT list_max(list_transform(e, lambda v: len(list_filter(e, lambda o: o = v)))) AS m0, list_max(list_transform(f1, lambda v: len(list_filter(f1, lambda o: o = v)))) AS m1, list_max(list_transform(f2, lambda v: len(list_filter(f2, lambda o: o = v)))) AS m2,
 list_max(list_transform(f3, lambda v: len(list_filter(f3, lambda o: o = v)))) AS m3, list_max(list_transform(f4, lambda v: len(list_filter(f4, lambda o: o = v)))) AS m4, list_max(list_transform(f5, lambda v: len(list_filter(f5, lambda o: o = v)))) AS m5 FROM f),
k AS (SELECT *, CASE WHEN m0 > 1 THEN 3 ELSE 2 END AS need FROM m)
SELECT CASE WHEN m1 >= need THEN 'spacing' WHEN m2 >= need THEN 'quotes' WHEN m3 >= need THEN 'spacing' WHEN m4 >= need THEN 'punctuation' WHEN m5 >= need THEN 'capitals' ELSE 'by words' END AS reason, count(*) AS n FROM k GROUP BY 1""")
def q47b_minor_reasons(spark: SparkSession, sf: str) -> DataFrame:
    kinds = _places(spark, sf).select(F.coalesce(reasons.minor_reason("readings"), F.lit("by words")).alias("reason"))
    return kinds.groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def q56_repaired_json(spark: SparkSession, sf: str) -> DataFrame:
    broken = F.when(F.col("event_id") % 3 == 0, F.expr("substring(props, 1, length(props) - 1)")).when(F.col("event_id") % 3 == 1, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    fixed = load(spark, sf, "events").select("event_id", scalars.repair_json(broken).alias("j"))
    return fixed.select("event_id", F.get_json_object("j", "$.k").cast("int").alias("k"))


@query()
def q57_documents_as_xml(spark: SparkSession, sf: str) -> DataFrame:
    @F.arrow_udf("string")
    def xml(ids: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True):
            parts = (t or "").split("\n")
            out.append(structure.to_xml(str(i), parts[0], [(p, structure.repair_spans(p, [(0, min(3, len(p)), "lead")])) for p in parts[1:]]))
        return pa.array(out, pa.string())

    return load(spark, sf, "documents").select("doc_id", F.sha2(xml("doc_id", "text"), 256).alias("digest"))


@query("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def q48_day_windows(spark: SparkSession, sf: str) -> DataFrame:
    return streams.run_once(spark, streams.day_windows(streams.event_stream(spark, sf)), "q48", "complete").select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH c AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
SELECT * FROM c WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)""")
def q48b_closed_days(spark: SparkSession, sf: str) -> DataFrame:
    """The days that no event can change any more, each given once."""
    return streams.run_once(spark, streams.day_windows(streams.event_stream(spark, sf)), "q48b", "append").select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, arg_max(event_type, row(ts, event_id)) AS status, count(*) AS seen FROM events GROUP BY 1")
def q49_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return streams.latest_state(spark, streams.event_stream(spark, sf))


_ROLES = ("Smith, J., dissenting, in which Jones concurs.", "JONES, J., concurring.", "Concurring in part and dissenting in part", "On Rehearing", "On the  merits", "unanimous court", "Plurality opinion", "We affirm", "dissenting, in part, but concurring in part", "concurrently filed")


@query(r"""
WITH r AS (SELECT o_orderkey, o_orderkey % 5 = 0 AS first, lower(regexp_replace(['Smith, J., dissenting, in which Jones concurs.', 'JONES, J., concurring.', 'Concurring in part and dissenting in part', 'On Rehearing', 'On the  merits', 'unanimous court', 'Plurality opinion', 'We affirm', 'dissenting, in part, but concurring in part', 'concurrently filed'][o_orderkey % 10 + 1], '\s+', ' ', 'g')) AS w FROM orders)
SELECT o_orderkey, CASE WHEN first THEN CASE WHEN contains(w, 'plurality') THEN 'plurality' WHEN contains(w, 'unanimous') THEN 'unanimous' ELSE 'majority' END WHEN contains(w, 'in part and dissenting in part') OR contains(w, 'in part, but concurring in part') THEN 'concurring-in-part-and-dissenting-in-part'
 WHEN regexp_matches(w, 'dissenting\b') THEN 'dissent' WHEN regexp_matches(w, 'concurring\b') THEN 'concurrence' WHEN contains(w, 'rehearing') THEN 'rehearing' WHEN contains(w, 'on the merits') THEN 'on-the-merits' END AS type FROM r""")
def q109_opinion_types(spark: SparkSession, sf: str) -> DataFrame:
    words = F.get(F.array(*map(F.lit, _ROLES)), (F.col("o_orderkey") % 10).cast("int"))
    return load(spark, sf, "orders").select("o_orderkey", scalars.opinion_type(words, F.col("o_orderkey") % 5 == 0).alias("type"))


@query(r"""
WITH t AS (SELECT l_orderkey, l_partkey, concat(CASE l_linenumber WHEN 1 THEN '  12. ' WHEN 2 THEN '†† ' WHEN 3 THEN '1234 ' WHEN 4 THEN '7)' WHEN 5 THEN '* ' ELSE 'x ' END, 'Text ', l_partkey) AS t FROM lineitem)
SELECT l_orderkey, l_partkey, nullif(regexp_extract(t, '^\s*([0-9]{1,3}|[*†‡§¶]{1,3})(?:[.)]\s*|\s+)', 1), '') AS label, CASE WHEN regexp_matches(t, '^\s*([0-9]{1,3}|[*†‡§¶]{1,3})([.)]|\s)') THEN regexp_extract(t, 'Text .*$') END AS rest FROM t""")
def q110_footnote_labels(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    lead = F.when(n == 1, "  12. ").when(n == 2, "†† ").when(n == 3, "1234 ").when(n == 4, "7)").when(n == 5, "* ").otherwise("x ")
    label = scalars.split_label(F.concat(lead, F.lit("Text "), F.col("l_partkey")))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", label["label"].alias("label"), label["rest"].alias("rest"))


@query(r"""
WITH t AS (SELECT o_orderkey, concat('Held. [Editor''s note: see ', o_custkey, '] and [ EDITORS’ Note', CASE WHEN o_orderkey % 2 = 0 THEN ' open' ELSE ' closed] end' END) AS t FROM orders)
SELECT o_orderkey, 2 AS n, CASE WHEN o_orderkey % 2 = 0 THEN '[ EDITORS’ Note open' ELSE '[ EDITORS’ Note closed]' END AS last, concat('[Editor''s note: see ', regexp_extract(t, 'see ([0-9]+)', 1), ']') AS first FROM t""")
def q111_editors_notes(spark: SparkSession, sf: str) -> DataFrame:
    end = F.when(F.col("o_orderkey") % 2 == 0, " open").otherwise(" closed] end")
    found = scalars.notes(F.concat(F.lit("Held. [Editor's note: see "), F.col("o_custkey"), F.lit("] and [ EDITORS’ Note"), end))
    return load(spark, sf, "orders").select("o_orderkey", F.size(found).alias("n"), F.element_at(found, -1).alias("last"), F.element_at(found, 1).alias("first"))


@query()
def q134_marks_of_a_vote(spark: SparkSession, sf: str) -> DataFrame:
    """Each reader marks one word of a line: the first bold, the second italic, the end of the third raised."""
    places = _places(spark, sf).withColumn("vote", consensus.voted("readings"))
    mark = lambda start, end, kind: F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("kind")))
    first = lambda r: F.length(F.substring_index(r, " ", 1))
    second = lambda r: F.length(F.substring_index(r, " ", 2))
    own = (lambda r: mark(F.lit(0), first(r), "bold"), lambda r: mark(first(r) + 1, second(r), "italic"), lambda r: mark(F.length(r) - 1, F.length(r), "sup"))
    said = F.array(*(F.struct(F.get("readings", F.lit(k)).alias("text"), make(F.get("readings", F.lit(k))).alias("marks")) for k, make in enumerate(own)))
    got = places.select("doc_id", "line", F.col("vote.text").alias("text"), marked.united_marks(F.col("vote.text"), said).alias("marks"))
    return got.select("doc_id", "line", F.size("marks").alias("n_marks"), F.md5(F.concat_ws("|", "text", F.to_json("marks"))).alias("digest"))


@query()
def q135_open_places(spark: SparkSession, sf: str) -> DataFrame:
    cards = _places(spark, sf).select("doc_id", "line", F.inline(marked.undecided_cards("readings")))
    return cards.select("doc_id", "line", "kind", "position", "start", "length", "level", F.posexplode("readings").alias("reader", "word"))


@query("""
SELECT l_orderkey, CAST(0 AS INTEGER) AS table_no, CAST(row_number() OVER (PARTITION BY l_orderkey, c.k ORDER BY l_linenumber, concat(l_partkey, '</td><td><b>', l_returnflag, '</b>', l_linestatus, '</td>', chr(10), '<td> ', l_suppkey, ' ')) AS INTEGER) AS row_no, CAST(c.k AS INTEGER) AS column_no,
 CASE c.k WHEN 0 THEN concat('line ', l_linenumber, ' & ', l_partkey) WHEN 1 THEN concat(l_returnflag, l_linestatus) ELSE CAST(l_suppkey AS VARCHAR) END AS cell FROM lineitem, (VALUES (0), (1), (2)) c(k)
UNION ALL SELECT o_orderkey, 0, 0, c.k, CASE c.k WHEN 0 THEN 'item' WHEN 1 THEN 'flags' ELSE 'supplier' END FROM orders, (VALUES (0), (1), (2)) c(k) WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def q136_table_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The line items of an order written as a table, and read back cell by cell."""
    row = F.concat(F.lit("<tr><td>line  "), F.col("l_linenumber"), F.lit(" &amp; "), F.col("l_partkey"), F.lit("</td><td><b>"), F.col("l_returnflag"), F.lit("</b>"), F.col("l_linestatus"), F.lit("</td>\n<td> "), F.col("l_suppkey"), F.lit(" </td></tr>"))
    rows = load(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", row.alias("row")).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"]), "\n")
    written = rows.groupBy("l_orderkey").agg(F.concat(F.lit("<p>Order</p><table><tr><th>item</th><th>flags</th><th>supplier</th></tr>"), body, F.lit("</table>")).alias("html"))
    return tables.cells(written, ["l_orderkey"], "html")
