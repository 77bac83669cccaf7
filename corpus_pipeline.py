"""The corpus pipeline: stages that each apply one operator to what the last one kept.

Stages take and return the columns of ``documents``, but for the last, whose rows are
the training schedule: a row for each time that a document is used.  SQL cannot
express the language model, the alignment or the suffix order, so there is no
``ORACLE_SQL``; the tests hold the stages against brute force.

For all stages: other columns than those named pass through, whatever their names and
types; an empty table gives an empty table; very long texts are handled whole.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.llm import decontaminate, jaccard_join, language_id, mixing, scratch, suffix_dedup

#: A language that is less sure than this is no language; guessing one of four has 0.25.
LEAST_LANGUAGE_SCORE = 0.4


def _packed(docs: DataFrame, *own: str) -> DataFrame:
    """The columns ``own`` and, in the struct ``carried``, all others, so that no name can clash."""
    rest = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*rest, F.lit(None).cast("int").alias("carried_end")).alias("carried"))


def _unpacked(packed: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    return packed.select(*(F.col(c) if c in own else F.col("carried").getField(c).alias(c) for c in docs.columns))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or without a likely language.

    The model learns from the stage's labelled documents.  Null and empty texts, and
    without any label all texts, go; a null id is held out of no training.  Equal scores
    go to the first language in alphabetical order, so equal texts stay or go together."""
    model = language_id.fit(docs.where(~language_id.held_out()).select("text", "lang"))
    found = language_id.predict(_packed(docs, "text"), model, keep=True)
    return _unpacked(found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)), docs, "text")


def _repeated_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of packed documents whose id no other row has, and one of each id and text of
    the others.

    The others, those with a null id among them, have a ``digest`` of the text and a
    ``row``, a number that is no id.  Only they are written."""
    again = scratch.stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    others = docs.where("doc_id IS NULL").unionByName(docs.join(again, "doc_id", "left_semi")).withColumn("digest", F.sha2("text", 256))
    rank = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy(F.to_json("carried")))
    others = others.withColumn("rank", rank).where("rank = 1").drop("rank").withColumn("at", F.monotonically_increasing_id())
    others = scratch.stored(others, "repeated-rows")
    # one row a partition that was written
    parts = sorted(others.groupBy(F.shiftright("at", 33).alias("part")).count().collect())
    ends = list(accumulate(n for _, n in parts))
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    total, first = (ends or [0])[-1], 0 if most is None else most + 1
    if first + total >= 1 << 63:
        first = least - total
    if first < -(1 << 63):
        raise ValueError("no numbers are left beside the ids")
    begins = docs.sparkSession.createDataFrame([(p, first + end - n) for (p, n), end in zip(parts, ends, strict=True)], "part long, begin long")
    numbered = others.join(F.broadcast(begins), F.shiftright("at", 33) == F.col("part"))
    numbered = numbered.withColumn("row", F.col("begin") + F.col("at").bitwiseAND((1 << 33) - 1)).select(*docs.columns, "digest", "row")
    return docs.where("doc_id IS NOT NULL").join(again, "doc_id", "left_anti").select(*docs.columns), numbered


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies.

    Documents without words are no copies and stay.  Rows are documents of their own,
    with a null id or one that others have, too: of rows equal in id and text one is
    kept, then of a group the row with the least id, a null id last, and text digest.
    Rows that share an id and differ in text are told apart."""
    single, others = _repeated_rows(_packed(docs, "doc_id", "text"))
    rows = single.select(F.col("doc_id").alias("row"), "text").unionByName(others.select("row", "text"))
    groups = scratch.stored(jaccard_join.near_duplicates(rows, "row", "text"), "near-copies")
    known = groups.join(others.select("row", "doc_id", "digest", F.lit(True).alias("other")), "row", "left")
    known = known.withColumn("doc_id", F.when(F.col("other"), F.col("doc_id")).otherwise(F.col("row")))
    kept = known.groupBy("component_id").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("kept"))
    gone = scratch.stored(known.join(kept, "component_id").where("row <> kept").select("row"), "gone")
    left = single.join(gone.select(F.col("row").alias("doc_id")), "doc_id", "left_anti")
    every = left.select(*single.columns).unionByName(others.join(gone, "row", "left_anti").select(*single.columns))
    return _unpacked(every, docs, "doc_id", "text")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 200 bytes that occur twice, to whole characters; texts of which nothing is left go.

    ``n_chars`` follows the text; null texts and those that were empty before stay as they
    are.  Rows that repeat are documents of their own, so each is a copy of the other."""
    cut = suffix_dedup.remove_repeated(_packed(docs, "doc_id", "text", "n_chars").withColumn("unread", F.col("text").isNull()), "doc_id", "text", carry=("carried", "unread"), whole_characters=True)
    cut = cut.where("n_removed = 0 OR octet_length(kept) > 0").withColumn("text", F.when(~F.col("unread"), F.col("kept").cast("string")))
    return _unpacked(cut.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)), docs, "doc_id", "text", "n_chars")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item or an edited copy of one.

    Rows go by id and text, so rows with a null id go as well, and rows that repeat go
    together.  Null texts match nothing and stay.  A score of exactly the least counts, so a
    tie with it goes; of equally good stretches any is enough."""
    packed = _packed(docs, "doc_id", "text")
    digest = F.sha2("text", 256)
    named = docs.select(F.struct("doc_id", digest.alias("digest")).alias("row"), "text")
    found = decontaminate.contaminated(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="row")
    gone = scratch.stored(found.select(F.col("row.doc_id").alias("gone_id"), F.col("row.digest").alias("gone_digest")).distinct(), "contaminated")
    left = packed.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (digest == F.col("gone_digest")), "left_anti")
    return _unpacked(left, docs, "doc_id", "text")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The schedule that mixes the sources at nine tenths of the greatest entropy.

    A null source is a source of its own; null and empty texts cost nothing; rows that
    repeat may share a place and are used equally often.  Where a column of the documents
    has a name of the schedule's, the schedule's gets a trailing ``_``."""
    light = scratch.stored(mixing.count_words(docs.select("doc_id", "source", "text"), "text").select("doc_id", "source", "tokens"), "tokens")
    return mixing.realise(docs, mixing.plan(light))


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_near_copies),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixing", mixed_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.stored(docs, name)
    return docs
