"""Joins, updates and reports of the review pages, as functions of DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.operators.relational import same_source


def orphans(objects: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """Objects of a sink that no row names."""
    return objects.join(named.select(key), key, "left_anti")


def update_by_key(current: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``current`` with the columns of matching ``updates``, which have each key once."""
    fresh = updates.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_hit"))
    both = current.join(fresh, list(keys), "left")
    return both.select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns))


def swap_if_unchanged(current: DataFrame, updates: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``current`` where ``column`` takes an update's ``value`` only if it still is its
    ``expected``; ``swapped`` says whether."""
    fresh = updates.select(*keys, F.col("expected").alias("_expected"), F.col("value").alias("_value"), F.lit(True).alias("_hit"))
    both = current.join(fresh, list(keys), "left")
    same = F.coalesce(F.col("_hit") & F.col(column).eqNullSafe(F.col("_expected")), F.lit(False))
    return both.select(*(F.when(same, F.col("_value")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in current.columns), same.alias("swapped"))


def requeued(status: Column, attempts: Column, most: int) -> tuple[Column, Column]:
    """Status and attempts of interrupted work: once more, or flagged after ``most`` attempts."""
    running = status == "running"
    return F.when(running & (attempts + 1 >= most), "failed").when(running, "queued").otherwise(status), F.when(running, F.least(attempts + 1, F.lit(most))).otherwise(attempts)


def request_filters(params: Mapping[str, object], allowed: Mapping[str, str]) -> list[Column]:
    """Conditions of a request's optional parameters; ``allowed`` names each one's column and
    comparison, as in ``{"least": "price >="}``.  Blank values ask for nothing."""
    made = []
    for name, value in params.items():
        if name not in allowed:
            raise ValueError(f"no filter {name}")
        if value in (None, "", []):
            continue
        column, how = allowed[name].split(" ")
        c = F.col(column)
        made.append({"=": lambda: c == value, ">=": lambda: c >= value, "<=": lambda: c <= value, "in": lambda: c.isin(*value), "prefix": lambda: c.startswith(value)}[how]())
    return made


def beside(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, offsets: Sequence[int]) -> DataFrame:
    """Left rows that have a right row at ``at`` plus one of ``offsets``: an equi-join on each place."""
    reach = right.select(*on, F.explode(F.array(*(F.col(at) - k for k in offsets))).alias(at)).distinct()
    return left.join(reach, [*on, at], "left_semi")


def newer_than(stamps: DataFrame, rows: DataFrame, on: Sequence[str], at: str, stamp: str) -> DataFrame:
    """Rows of ``stamps`` after whose ``stamp`` some row of the same keys came: the last one decides."""
    last = rows.groupBy(*on).agg(F.max(at).alias("_last"))
    return stamps.join(last, list(on)).where(F.col("_last") > F.col(stamp)).drop("_last")


def wildcard_join(left: DataFrame, right: DataFrame, on: Sequence[str], source: str) -> DataFrame:
    """Rows of the same keys whose fingerprints agree, a blank one with all; the right one as ``right_<source>``."""
    r = right.withColumnRenamed(source, f"right_{source}")
    return left.join(r, list(on)).where(same_source(F.col(source), F.col(f"right_{source}")))


def rehome(rows: DataFrame, places: DataFrame, keys: Sequence[str], place: str) -> DataFrame:
    """Rows with their place in the new order; those without one are kept and ``placed`` is false."""
    return rows.join(places.select(*keys, place), list(keys), "left").withColumn("placed", F.col(place).isNotNull())


def between_keys(points: DataFrame, marks: DataFrame, on: Sequence[str], at: str) -> DataFrame:
    """Points strictly between two neighbouring marks of their keys, with both: two windows, no range join."""
    both = points.withColumn("_mark", F.lit(None).cast(marks.schema[at].dataType)).unionByName(marks.select(*on, at, F.col(at).alias("_mark")), allowMissingColumns=True).withColumn("_point", F.col("_mark").isNull())
    order = Window.partitionBy(*on).orderBy(at)
    before = F.max("_mark").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min("_mark").over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    seen = both.withColumn("before", before).withColumn("after", after).where(F.col("_point") & (F.col("before") < F.col(at)) & (F.col(at) < F.col("after")))
    return seen.select(*points.columns, "before", "after")


def clip_at_next(spans: DataFrame, marks: DataFrame, on: Sequence[str], start: str, end: str, at: str) -> DataFrame:
    """Spans that end at the first mark after their start that they run through, as ``clipped``."""
    every = spans.withColumn("_at", F.col(start)).withColumn("_span", F.lit(1)).unionByName(marks.select(*on, F.col(at).alias("_at"), F.col(at).alias("_mark"), F.lit(0).alias("_span")), allowMissingColumns=True)
    following = F.min("_mark").over(Window.partitionBy(*on).orderBy("_at", "_span").rowsBetween(1, Window.unboundedFollowing))
    return every.withColumn("_next", following).where("_span = 1").withColumn("clipped", F.least(F.col(end), F.col("_next"))).select(*spans.columns, "clipped")


def first_known(base: DataFrame, key: str, value: str, sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Each key's first value over sources in the order of their rank, with the source's name."""
    out = base
    for name, df in sources:
        out = out.join(df.select(key, F.col(value).alias(f"_{name}")), key, "left")
    named = F.coalesce(*(F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n, _ in sources))
    return out.select(*base.columns, F.coalesce(*(F.col(f"_{n}") for n, _ in sources)).alias(value), named.alias("source_name"))


def report(sections: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Counts by one column each, all sections in one table of ``section``, ``name`` and ``n``."""
    out = None
    for section, (df, by) in sections.items():
        one = df.groupBy(F.col(by).cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "name", "n")
        out = one if out is None else out.unionByName(one)
    return out


def phrase(df: DataFrame, keys: Sequence[str], status: str) -> DataFrame:
    """``label``: each status with its count, in order of the name, as ``3 done, 1 failed``."""
    counts = df.groupBy(*keys, status).agg(F.count("*").alias("_n"))
    listed = F.array_sort(F.collect_list(F.struct(status, "_n")))
    return counts.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(" ", x["_n"], x[status])), ", ").alias("label"))


def run_summary(df: DataFrame, keys: Sequence[str], run: str, order: str, done: Column, failed: Column, error: Column) -> DataFrame:
    """Of each key's live run: rows, done, open, failed, and the first error in order."""
    live = df.groupBy(*keys).agg(F.max(run).alias(run))
    rows = df.join(live, [*keys, run])
    return rows.groupBy(*keys, run).agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(~done & ~failed).alias("open"), F.count_if(failed).alias("failed"), F.min_by(error, F.when(failed, F.col(order))).alias("first_error"))


def covered(expected: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Whether the whole ranges of a key, joined, hold its expected ``[first, last]``.

    ``ranges`` has ``start`` and ``end``; one with a missing end is skipped, and without an
    expectation nothing is covered.  A sweep with the greatest end so far finds the gaps."""
    whole = expected.select(key, "first", "last").join(ranges.where("start IS NOT NULL AND end IS NOT NULL AND start <= end"), key).where("end >= first AND start <= last")
    order = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(order), F.col("first") - 1)
    swept = whole.withColumn("_gap", F.col("start") > reach + 1).groupBy(key).agg(F.bool_or("_gap").alias("_gap"), F.max("end").alias("_reach"))
    good = F.coalesce(~F.col("_gap") & (F.col("_reach") >= F.col("last")), F.lit(False))
    return expected.join(swept, key, "left").select(key, good.alias("covered"))


def nested(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rows") -> DataFrame:
    """One row a key with its rows as an ordered array."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))


def holes(df: DataFrame, named: str, had: str) -> Column:
    """Numbers of the array ``named`` that ``had`` lacks, in order."""
    return F.array_sort(F.array_except(F.col(named), F.col(had)))


def standing(computed: DataFrame, human: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Computed rows that no human row replaces, and the human rows."""
    return computed.join(human.select(*keys), list(keys), "left_anti").unionByName(human)


def set_xor(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side alone, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def hardest(types: Column, order: Sequence[str]) -> Column:
    """Of an array of type names the one that comes first in ``order``; others count for nothing."""
    rank = F.create_map(*(F.lit(x) for k, name in enumerate(order) for x in (name, k)))
    known = F.transform(F.filter(types, lambda t: t.isin(*order)), lambda t: F.struct(rank[t].alias("rank"), t.alias("name")))
    return F.array_min(known)["name"]


def listing_order(params: Mapping[str, object], key: str, page: Sequence[str], volume: Sequence[str], newest: str) -> list[Column]:
    """The order of a list: by page if one item is asked for, by volume and page if a volume is,
    else newest first; it always ends in the key, so it is total."""
    asked = {k for k, v in params.items() if v not in (None, "")}
    columns = [F.col(c).asc() for c in page] if "item" in asked else [F.col(c).asc() for c in (*volume, *page)] if "volume" in asked else [F.col(newest).desc()]
    return [*columns, F.col(key).asc()]


def page_of(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of a list in a total order: a top-k of the first pages."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def worst_first(df: DataFrame, score: str, least: float, *ties: str) -> DataFrame:
    """Rows that score at least ``least``, worst first."""
    return df.where(F.col(score) >= least).orderBy(F.desc(score), *ties)
