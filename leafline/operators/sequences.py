"""Operators over ordered rows: gaps, islands, neighbours, runs and shard plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.operators.relational import as_of

def islands(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Runs ``(start, end, n)`` of consecutive integers of each key.

    Values are grouped by ranges of 2**16 first.  Without keys, only the runs that touch the
    end of a range, at most two a range, meet in one task."""
    part = F.floor(F.col(value) / 65536)
    local = Window.partitionBy(*keys, "_part").orderBy(value)
    pieces = df.select(*keys, value).distinct().withColumn("_part", part).withColumn("_run", F.col(value) - F.row_number().over(local))
    pieces = pieces.groupBy(*keys, "_part", "_run").agg(F.min(value).alias("start"), F.max(value).alias("end"))
    if keys:
        order = Window.partitionBy(*keys).orderBy("start")
        joined = pieces.withColumn("_new", (F.coalesce(F.lag("end").over(order) + 1 != F.col("start"), F.lit(True))).cast("int")).withColumn("_id", F.sum("_new").over(order))
        return joined.groupBy(*keys, "_id").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*keys, "start", "end", (F.col("end") - F.col("start") + 1).alias("n"))
    # pieces inside of a range are whole runs; only those that touch both ends of neighbouring
    # ranges go on, at most two a range, and only these meet in one window
    begins, ends = F.col("start") == F.col("_part") * 65536, F.col("end") == F.col("_part") * 65536 + 65535
    inner = pieces.where(~begins & ~ends).select("start", "end")
    order = Window.orderBy("start")
    edge = pieces.where(begins | ends).withColumn("_new", (F.coalesce(F.lag("end").over(order) + 1 != F.col("start"), F.lit(True))).cast("int")).withColumn("_id", F.sum("_new").over(order))
    merged = edge.groupBy("_id").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("start", "end")
    return inner.unionByName(merged).select("start", "end", (F.col("end") - F.col("start") + 1).alias("n"))


def coverage_gaps(bounds: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Pages of ``[first, last]`` that no span covers, as runs; no bounds or no spans: nothing."""
    pages = bounds.where("first IS NOT NULL AND last IS NOT NULL").join(spans.select(key).distinct(), key, "left_semi").select(key, F.explode(F.sequence("first", "last")).alias("page"))
    held = spans.where("start <= end").select(key, F.explode(F.sequence("start", "end")).alias("page"))
    return islands(pages.join(held, [key, "page"], "left_anti"), "page", [key])


def contiguous(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: rows, whether values are 0 to n-1, and how often they do not follow one another."""
    order = Window.partitionBy(*keys).orderBy(value)
    step = df.withColumn("_broken", (F.col(value) - F.lag(value).over(order)) != 1)
    return step.groupBy(*keys).agg(F.count("*").alias("n"), ((F.min(value) == 0) & (F.max(value) == F.count("*") - 1) & (F.count_if("_broken") == 0)).alias("whole"), F.count_if("_broken").alias("breaks"))


def by_neighbours(df: DataFrame, keys: Sequence[str], order: str, value: str, candidates: str) -> DataFrame:
    """A value between neighbours that agree on it is replaced if it is one of ``candidates``; neighbours are read as they were."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    wanted = before + 1
    fix = (wanted == after - 1) & (F.col(value) != wanted) & F.array_contains(candidates, wanted)
    return df.withColumn("resolved", F.when(F.coalesce(fix, F.lit(False)), wanted).otherwise(F.col(value)))


def interpolate(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """``expected``: a line between the known neighbours, or one step a row from the only one; half to even."""
    w = Window.partitionBy(*keys).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("at"), F.col(value).alias("v")))
    left = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    seen = df.withColumn("_l", left).withColumn("_r", right)
    line = F.col("_l.v") + (F.col("_r.v") - F.col("_l.v")) * (F.col(order) - F.col("_l.at")) / (F.col("_r.at") - F.col("_l.at"))
    one = F.coalesce(F.col("_l.v") + F.col(order) - F.col("_l.at"), F.col("_r.v") - (F.col("_r.at") - F.col(order)))
    return seen.withColumn("expected", F.bround(F.coalesce(line, one.cast("double"))).cast("long")).drop("_l", "_r")


def modal_offset(df: DataFrame, keys: Sequence[str], value: str, expected: str, order: str) -> DataFrame:
    """Shifts a key's values by their commonest offset, if that is not 0 and holds for half of them."""
    off = df.where(F.col(value).isNotNull()).withColumn("_off", F.col(value) - F.col(expected))
    n = off.groupBy(*keys, "_off").agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = n.groupBy(*keys).agg(F.min_by("_off", F.struct(-F.col("_n"), F.col("_first"))).alias("_off"), F.max("_n").alias("_n"), F.sum("_n").alias("_all"))
    fixed = F.when((F.col("_off") != 0) & (F.col("_n") * 2 >= F.col("_all")), F.col(value) - F.col("_off")).otherwise(F.col(value))
    return df.join(best, list(keys), "left").withColumn("corrected", fixed).drop("_off", "_n", "_all")


def sequence_checks(df: DataFrame, keys: Sequence[str], order: str, number: str, most_missing: int = 6) -> DataFrame:
    """Findings of each key: ``missing`` numbers, ``large_gap`` for longer runs of them, ``duplicate`` and ``backward``."""
    w = Window.partitionBy(*keys).orderBy(order)
    back = df.withColumn("_prev", F.lag(number).over(w)).where(F.col(number) < F.col("_prev")).select(*keys, F.lit("backward").alias("finding"), F.col(number).alias("first"), F.col(number).alias("last"))
    twice = df.groupBy(*keys, number).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys, F.lit("duplicate").alias("finding"), F.col(number).alias("first"), F.col(number).alias("last"))
    numbers = df.where(F.col(number).isNotNull()).select(*keys, number).distinct()
    hole = numbers.withColumn("_next", F.lead(number).over(Window.partitionBy(*keys).orderBy(number))).where(F.col("_next") > F.col(number) + 1)
    kind = F.when(F.col("_next") - F.col(number) - 1 > most_missing, "large_gap").otherwise("missing")
    missing = hole.select(*keys, kind.alias("finding"), (F.col(number) + 1).alias("first"), (F.col("_next") - 1).alias("last"))
    return missing.unionByName(twice).unionByName(back)


def worst_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, k: int = 5) -> DataFrame:
    """Greatest and least mean of ``k`` consecutive rows; keys with at most ``k`` rows have their mean."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = df.withColumn("_m", F.avg(value).over(w.rowsBetween(0, k - 1))).withColumn("_full", F.count("*").over(w.rowsBetween(0, k - 1)) == k).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    full = F.when(F.col("_full"), F.col("_m"))
    return run.groupBy(*keys).agg(F.when(F.max("_n") <= k, F.avg(value)).otherwise(F.max(full)).alias("most"), F.when(F.max("_n") <= k, F.avg(value)).otherwise(F.min(full)).alias("least"))


def running_median(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, k: int = 5) -> DataFrame:
    """Median of the rows around each, the lower middle at the ends."""
    around = F.sort_array(F.collect_list(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(k // 2), k // 2)))
    return df.withColumn("_around", around).withColumn("smooth", F.element_at("_around", F.floor((F.size("_around") + 1) / 2).cast("int"))).drop("_around")


def segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], separator: Column) -> DataFrame:
    """``segment``: how many separators came up to this row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("segment", F.count_if(separator).over(w))


def widest_gap(df: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """The widest stretch that no interval touches: a sweep with the greatest right end so far."""
    w = Window.partitionBy(*keys).orderBy(left, right)
    reach = F.max(right).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gaps = df.withColumn("_reach", reach).withColumn("gap", F.col(left) - F.col("_reach")).where("gap > 0")
    return gaps.groupBy(*keys).agg(F.max_by(F.struct(F.col("_reach").alias("start"), F.col(left).alias("end")), F.struct("gap", -F.col("_reach"))).alias("g")).select(*keys, "g.start", "g.end")


def plan_shards(df: DataFrame, pages: str, size: str, most_bytes: int, most_pages: int) -> DataFrame:
    """``min(pages, max(1, ceil(size / most_bytes), ceil(pages / most_pages)))`` nearly equal page ranges."""
    n = F.least(F.col(pages), F.greatest(F.lit(1), F.ceil(F.col(size) / most_bytes), F.ceil(F.col(pages) / most_pages)))
    cut = df.where(F.col(pages) > 0).withColumn("shards", n.cast("long")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    edge = lambda k: F.floor(k * F.col(pages) / F.col("shards")).cast("long")
    return cut.withColumn("first_page", edge(F.col("shard"))).withColumn("last_page", edge(F.col("shard") + 1) - 1)


def slot_order(pages: DataFrame, edits: DataFrame, key: str, page: str) -> DataFrame:
    """The final order after edits, one row a final page: what it is made of and where it stands.

    ``edits`` has ``key``, ``page``, ``kind`` and ``target``, and may have ``count`` and ``turn``.
    A delete drops its page, a replace puts ``count`` pages in its slot, a rotate turns it by
    ``turn``; the first of these three wins.  A move takes what the page became to the gap after
    ``target``, in page order; inserts of ``count`` pages follow there, in the order of ``page``."""
    for name, kind in (("count", "int"), ("turn", "int")):
        if name not in edits.columns:
            edits = edits.withColumn(name, F.lit(None).cast(kind))
    of = lambda kind, value: F.max(F.when(F.col("kind") == kind, value))
    many = F.coalesce("count", F.lit(1))
    own = edits.where("kind <> 'insert'").groupBy(key, page).agg(of("delete", F.lit(1)).alias("_gone"), of("move", F.col("target")).alias("_to"), of("replace", many).alias("_new"), of("rotate", F.col("turn")).alias("_turn"))
    kept = pages.select(key, page).join(own, [key, page], "left").where("_gone IS NULL")
    made = F.when(F.col("_new").isNotNull(), "replace").when(F.col("_turn").isNotNull(), "rotate").otherwise("original")
    turn = F.when(made == "rotate", F.col("_turn"))
    slot, rank = F.coalesce("_to", page), F.col("_to").isNotNull().cast("int")
    rows = kept.select(key, F.col(page).alias("source"), made.alias("made"), turn.alias("turn"), slot.alias("_slot"), rank.alias("_rank"), F.col(page).alias("_tie"), F.coalesce("_new", F.lit(1)).alias("_n"))
    new = edits.where("kind = 'insert'").select(key, F.lit(None).cast(pages.schema[page].dataType).alias("source"), F.lit("insert").alias("made"), F.lit(None).cast("int").alias("turn"), F.col("target").alias("_slot"), F.lit(2).alias("_rank"), F.col(page).alias("_tie"), many.alias("_n"))
    every = rows.unionByName(new).where("_n > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    order = Window.partitionBy(key).orderBy("_slot", "_rank", "_tie", "part")
    return every.withColumn("final", F.row_number().over(order) - 1).select(key, "source", "made", "part", "turn", "final")


def trailing_gap(df: DataFrame, keys: Sequence[str], order: str, known: Column) -> DataFrame:
    """The run of rows after each key's last known one, as one placeholder ``(start, end, n)``."""
    last = F.max(F.when(known, F.col(order)))
    ends = df.groupBy(*keys).agg(last.alias("_last"), F.max(order).alias("end"), F.min(order).alias("_first"))
    start = F.coalesce(F.col("_last") + 1, F.col("_first"))
    return ends.withColumn("start", start).where("start <= end").select(*keys, "start", "end", (F.col("end") - F.col("start") + 1).alias("n"))


def flagged_runs(df: DataFrame, keys: Sequence[str], order: str, flag: Column) -> DataFrame:
    """Runs ``(start, end, n)`` of neighbouring flagged rows; a missing number ends a run."""
    w = Window.partitionBy(*keys).orderBy(order)
    some = df.where(flag).withColumn("_run", F.col(order) - F.row_number().over(w))
    return some.groupBy(*keys, "_run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("_run")


def restarts(df: DataFrame, keys: Sequence[str], order: Sequence[str], number: str, step: int = 3) -> DataFrame:
    """``series``: how often numbers began again, at one of at most ``step`` that is not above the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    again = F.coalesce(F.col(number) <= F.least(F.lag(number).over(w), F.lit(step)), F.lit(False))
    return df.withColumn("_again", again).withColumn("series", F.count_if("_again").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_again")


def overlap_groups(df: DataFrame, keys: Sequence[str], left: str, right: str, tie: str, share: float = 0.5) -> DataFrame:
    """``column``: boxes from left to right; one begins a new column unless more than ``share``
    of its own width lies in the reach of the column so far.

    The reach begins anew with each column, so the boxes of a key are folded in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(left).cast("double").alias("a"), F.col(tie).alias("id"), F.col(right).cast("double").alias("b"))))
    start = F.struct(F.lit(None).cast("double").alias("reach"), F.lit(-1).alias("column"), F.array().cast(f"array<struct<id:{df.schema[tie].dataType.simpleString()},column:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        inside = s["reach"].isNotNull() & (F.least(x["b"], s["reach"]) - x["a"] > (x["b"] - x["a"]) * share)
        column = F.when(inside, s["column"]).otherwise(s["column"] + 1)
        return F.struct(F.when(inside, F.greatest(s["reach"], x["b"])).otherwise(x["b"]).alias("reach"), column.alias("column"), F.concat(s["out"], F.array(F.struct(x["id"].alias("id"), column.alias("column")))).alias("out"))

    folded = df.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, F.explode(F.aggregate("_rows", start, step)["out"]).alias("_o"))
    return folded.select(*keys, F.col("_o.id").alias(tie), F.col("_o.column").alias("column"))


def accepted_labels(df: DataFrame, keys: Sequence[str], order: Sequence[str], number: str, step: int = 3) -> DataFrame:
    """``labels``: of each key's numbers in order those that are above the last accepted one by 1 to ``step``."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(number).cast("int").alias("_n"))))
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("out"))

    def take(s: Column, x: Column) -> Column:
        good = (x["_n"] > s["last"]) & (x["_n"] <= s["last"] + step)
        return F.struct(F.when(good, x["_n"]).otherwise(s["last"]).alias("last"), F.when(good, F.concat(s["out"], F.array(x["_n"]))).otherwise(s["out"]).alias("out"))

    return df.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, F.aggregate("_rows", start, take)["out"].alias("labels"))


def printed_spans(boundaries: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    """``first`` and ``last`` printed page of each boundary (``start``, ``end``), or its ``fault``.

    ``numbers`` has ``page``, ``low`` and, on pages that print a range, ``high``.  A range gives
    its end to what begins there and its start to what ends there; what lies on one page has all
    of it.  The last number is that of the last numbered page after the start, so pages without
    one at the end are skipped.  Faults: ``no_number`` at the start, ``backwards``."""
    begins = numbers.select(key, F.col("page").alias("start"), F.col("low").alias("_low"), F.coalesce("high", "low").alias("_high"))
    found = as_of(boundaries.join(begins, [key, "start"], "left"), numbers, [key], "page", ["low"], left_at="end")
    within = F.col("end") <= F.col("start")
    first = F.when(within, F.col("_low")).otherwise(F.col("_high"))
    last = F.when(within, F.col("_high")).when(F.col("matched_at") > F.col("start"), F.col("matched_low")).otherwise(first)
    fault = F.when(F.col("_low").isNull(), "no_number").when(last < first, "backwards")
    good = lambda c: F.when(fault.isNull(), c)
    return found.select(*boundaries.columns, good(first).alias("first"), good(last).alias("last"), fault.alias("fault"))
