"""Readers and writers: schemas are declared, files are checked before they are trusted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table; Parquet reads only the columns and row groups that a query needs."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_json_document(spark: SparkSession, path: str, schema: StructType | str, schema_version: int | None = None) -> DataFrame:
    """Whole-file JSON documents; with ``schema_version``, any other version stops the query."""
    docs = spark.read.schema(schema).json(path, multiLine=True)
    return docs if schema_version is None else checked_envelope(docs, F.col("schema") == schema_version, "schema version")


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def checked_envelope(df: DataFrame, good: Column, what: str) -> DataFrame:
    """Refuses the whole input if a row is not ``good``; null counts as not good."""
    return df.where(F.coalesce(good, F.lit(False)) | F.raise_error(F.lit(f"unexpected {what}")).isNotNull())


def read_parts(df: DataFrame, group: Sequence[str], part: str, first: str, last: str) -> DataFrame:
    """Parts of a run, which must be numbered 0 to n-1 and follow one another without a gap."""
    order = Window.partitionBy(*group).orderBy(part)
    seen = df.withColumn("_rank", F.row_number().over(order) - 1).withColumn("_before", F.lag(last).over(order))
    good = (F.col(part) == F.col("_rank")) & (F.col("_before").isNull() | (F.col(first) == F.col("_before") + 1))
    return checked_envelope(seen, good, "part numbers or page ranges").drop("_rank", "_before")


def read_queue_csv(spark: SparkSession, path: str) -> DataFrame:
    """The queue of volumes, tab-separated: rows of one volume become one row.

    The first row in the file gives status and source; page ranges widen over all rows; any
    row with a part label makes the volume partial.  Rows without slug or volume go."""
    raw = spark.read.csv(path, header=True, sep="\t", enforceSchema=False, schema="`Slug` string, `Volume #` string, `Part` string, `Status` string, `First Page` string, `Last Page` string, `Located` string")
    status = F.lower(F.trim("Status"))
    named = F.when(status.isin("done", "complete"), "complete").when(status == "captured", "captured").when(status == "in progress", "in_work").otherwise("waiting")
    page = lambda c: F.trim(F.col(c)).try_cast("int")
    rows = raw.select(F.trim("Slug").alias("reporter"), F.trim("Volume #").alias("volume"), named.alias("status"), F.trim("Located").alias("located"), (F.coalesce(F.trim("Part"), F.lit("")) != "").alias("part"), page("First Page").alias("first_page"), page("Last Page").alias("last_page"), F.monotonically_increasing_id().alias("row"))
    volumes = rows.where("reporter <> '' AND volume <> ''").groupBy("reporter", "volume")
    return volumes.agg(F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"), F.count("*").alias("parts"), F.bool_or("part").alias("partial"), F.min_by("status", "row").alias("status"), F.min_by("located", "row").alias("located"))


def checked_results(df: DataFrame, action: str, item: int, schema_version: int) -> DataFrame:
    """Results of a worker; one of another action, item or schema version stops the query."""
    checked = checked_envelope(df, F.col("action") == action, "action")
    return checked_envelope(checked_envelope(checked, F.col("item") == item, "item"), F.col("schema") == schema_version, "schema version")


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """Keys and sizes below a path; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def replace_sets(df: DataFrame, path: str, set_columns: Sequence[str]) -> None:
    """Replaces the sets that ``df`` has rows of and leaves the others; writing twice is the same as once.

    Partition folders are renamed one by one, so a reader beside the writer may see some sets
    new and others old; the committer's marker comes last."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*set_columns).parquet(path)


def write_documents(df: DataFrame, path: str, text: str) -> None:
    """One text per document, such as XML, one document a line group."""
    df.select(text).write.mode("overwrite").text(path)


def upsert(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Full outer match by natural key: ``state`` is new, match or stale; fresh values win."""
    a, b = stored.withColumn("_s", F.lit(True)).alias("a"), fresh.withColumn("_f", F.lit(True)).alias("b")
    both = a.join(b, list(keys), "full_outer")
    state = F.when(F.col("_s").isNull(), "new").when(F.col("_f").isNull(), "stale").otherwise("match")
    return both.select(*keys, *(F.when(F.col("_f").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in columns), state.alias("state"))


def fetch_in_order(df: DataFrame, key: str, ids: Sequence[int]) -> DataFrame:
    """The rows of ``ids`` in the caller's order."""
    wanted = df.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], f"{key} long, position int")
    return df.join(wanted, key).orderBy("position")
