"""Joins and aggregates of a review workflow, as functions of DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def any_of(*conditions: Column) -> Column:
    """OR of conditions, null as false."""
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions))


def none_of(*conditions: Column) -> Column:
    """Negation that keeps rows for which a condition is null."""
    return ~any_of(*conditions)


def same_source(a: Column, b: Column) -> Column:
    """Fingerprints agree; a blank one agrees with all."""
    return (a == "") | (b == "") | (a == b)


def latest(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``; ``order`` must be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def live_run(df: DataFrame, keys: Sequence[str], run: str) -> DataFrame:
    """All rows of each key's greatest run."""
    return df.withColumn("_run", F.max(run).over(Window.partitionBy(*keys))).where(F.col(run) == F.col("_run")).drop("_run")


def grouped_report(df: DataFrame, members: DataFrame, on: Sequence[str], group: str, distinct: str) -> DataFrame:
    """Count and distinct count of each named group, groups without rows at 0, and a total row.

    ``members`` maps values to groups; it is a literal of the program, so it is broadcast."""
    named = df.join(F.broadcast(members), list(on), "left").select(group, distinct)
    counted = named.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(distinct).alias("n_distinct"))
    groups = members.select(group).distinct().join(counted, group, "left")
    total = df.agg(F.count("*").alias("n"), F.count_distinct(distinct).alias("n_distinct")).select(F.lit("total").alias(group), "n", "n_distinct")
    return groups.unionByName(total).select(group, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def funnel(df: DataFrame, key: str, stages: Mapping[str, Column]) -> DataFrame:
    """Keys that ever meet each stage; stages may overlap, an empty stage reads 0."""
    flags = df.groupBy(key).agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(s) for s, c in stages.items()))
    sums = flags.agg(*(F.count_if(F.col(s)).alias(s) for s in stages))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("n")) for s in stages))).alias("r")).select("r.stage", "r.n")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, columns: Sequence[str], left_at: str | None = None) -> DataFrame:
    """Each left row with the last right row of its keys at or before it: one shuffle, one sort, no range join.

    Right rows at the same instant count; of equal right instants, the one with the greatest columns.
    ``left_at`` names the left side's instant where it differs from ``at``."""
    r = right.select(*keys, F.col(at).alias("_at"), F.struct(F.col(at).alias("_at"), *columns).alias("_r"))
    both = left.withColumn("_at", F.col(left_at or at)).withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).withColumn("_left", F.lit(1))
    both = both.unionByName(r.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_at", "_left", "_r").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_r", F.last("_r", ignorenulls=True).over(order)).where("_left = 1")
    return filled.select(*left.columns, F.col("_r._at").alias("matched_at"), *(F.col(f"_r.{c}").alias(f"matched_{c}") for c in columns))


def point_in_interval(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Points with each interval ``[start, end]`` that holds them; numbers are cut to buckets of ``width``, so the join is an equi-join."""
    spread = intervals.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return points.withColumn("_bucket", F.floor(F.col(at) / width)).join(spread, [*keys, "_bucket"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_bucket")


def reconcile(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``state`` of each key: match, new (fresh only) or orphan (stored only)."""
    a, b = stored.select(key).withColumn("_a", F.lit(1)), fresh.select(key).withColumn("_b", F.lit(1))
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "orphan").otherwise("match")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def card_state(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What becomes of review cards when findings are computed anew.

    ``stored`` has ``status`` (open, answered, applied), ``readings`` and ``minor``; ``fresh`` has ``readings``."""
    s = stored.select(*keys, "status", "minor", F.col("readings").alias("_old"), F.lit(True).alias("_s"))
    f = fresh.select(*keys, F.col("readings").alias("_new"), F.lit(True).alias("_f"))
    changed = ~F.col("_old").eqNullSafe(F.col("_new"))
    action = (
        F.when(F.col("_s").isNull(), "create")
        .when(F.col("_f").isNull() & (F.col("status") == "applied"), "keep")
        .when(F.col("_f").isNull(), "delete")
        .when((F.col("status") == "answered") & changed, "stale")
        .when((F.col("status") == "applied") & ~F.coalesce(F.col("minor"), F.lit(False)), "reopen")
        .otherwise("keep")
    )
    return s.join(f, list(keys), "full_outer").select(*keys, action.alias("action"))


def admit(df: DataFrame, group: str, pending: Column, flying: Column, cap: int, *order: str) -> DataFrame:
    """Pending rows that fit below a cap less what is in flight, first in order."""
    room = cap - F.count_if(flying).over(Window.partitionBy(group))
    rank = F.row_number().over(Window.partitionBy(group, "_pending").orderBy(*order))
    return df.withColumn("_pending", pending).withColumn("_room", room).withColumn("admit_rank", rank).where(F.col("admit_rank") <= cap).where("_pending AND admit_rank <= _room").drop("_pending", "_room")


def whole_groups(df: DataFrame, group: str, budget: int, size: str = "n") -> DataFrame:
    """Groups in order until the first that passes the budget; the first group is always taken.

    ``df`` has one row a group.  Running sums are made within ranges of groups and joined
    by range totals, so no task sees all groups."""
    parts = Window.partitionBy("_part").orderBy(group)
    ranged = df.repartitionByRange(group).withColumn("_part", F.spark_partition_id()).withColumn("_sum", F.sum(size).over(parts))
    totals = ranged.groupBy("_part").agg(F.max("_sum").alias("_total"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    summed = ranged.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("running", F.col("_sum") + F.col("_before"))
    return summed.where((F.col("running") <= budget) | (F.col("running") == F.col(size))).select(*df.columns, "running")


def over_cap(df: DataFrame, cap: int) -> bool:
    """Whether there are more than ``cap`` rows, found without counting all."""
    return not df.offset(cap).isEmpty()


def reusable(todo: DataFrame, done: DataFrame, keys: Sequence[str], *newest: str) -> DataFrame:
    """Work items with the newest finished result of the same content, if there is one."""
    return todo.join(latest(done, keys, *newest), list(keys), "left")
