"""Coverage algebra over closed intervals: merge, subtract, widen, clip, and the commit rule.

Intervals are rows (key columns, start, end). Ends that touch merge; what is left over keeps the boundary it shares.
Windows partition by key, so the algebra scales with the number of keys; range joins go through day buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(ranges: DataFrame, keys: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """Maximal covered intervals of each key."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    island = F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        ranges.where(F.col(end) >= F.col(start)).withColumn("_open", opens).withColumn("_island", island)
        .groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
    )


def merge_labelled(ranges: DataFrame, keys: list[str], label: str, new: str, start: str = "s", end: str = "e") -> DataFrame:
    """``merge`` with a source label: the new source's if any part is its, else that of the block's last part."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    island = F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        ranges.withColumn("_open", opens).withColumn("_island", island).groupBy(*keys, "_island")
        .agg(F.min(start).alias("_s"), F.max(end).alias("_e"), F.max((F.col(label) == new).cast("int")).alias("_new"), F.max_by(label, F.struct(start, end, label)).alias("_last"))
        .select(*keys, F.col("_s").alias(start), F.col("_e").alias(end), F.when(F.col("_new") == 1, F.lit(new)).otherwise(F.col("_last")).alias(label))
    )


def subtract(requests: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """What of each request (keys, qs, qe) the ranges (keys, s, e) leave uncovered: rows (keys, qs, qe, gs, ge).

    A point request is left only if no range holds it. A request without any coverage is one gap, itself.
    """
    covered = merge(ranges, keys)
    near = requests.join(covered, keys, "left").where("s is null or (s <= qe and e >= qs)")
    lone = requests.join(covered, [*(requests[k] == covered[k] for k in keys), covered["s"] <= requests["qe"], covered["e"] >= requests["qs"]], "left_anti")
    order = Window.partitionBy(*keys, "qs", "qe").orderBy("s")
    hit = near.where("s is not null").withColumns({"_prev": F.lag("e").over(order), "_next": F.lead("s").over(order)})
    before = hit.where("_prev is null and s > qs").select(*keys, "qs", "qe", F.col("qs").alias("gs"), F.col("s").alias("ge"))
    between = hit.select(*keys, "qs", "qe", F.col("e").alias("gs"), F.when(F.col("_next").isNotNull(), F.col("_next")).otherwise(F.col("qe")).alias("ge")).where("gs < ge")
    whole = lone.select(*keys, "qs", "qe", F.col("qs").alias("gs"), F.col("qe").alias("ge"))
    return before.unionByName(between).unionByName(whole)


def widen(gaps: DataFrame, days: float, start: str = "gs", floor: str = "qs") -> DataFrame:
    """Read a little before each gap, not before the request."""
    back = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86400.0))
    return gaps.withColumn("read_from", F.greatest(F.col(floor), F.col(start) - back))


def pollable(end: Column, snapshot: Column) -> Column:
    return F.least(end, snapshot)


def deferred(end: Column, snapshot: Column) -> Column:
    """Where the part after the poll snapshot begins; null if there is none."""
    return F.when(end > snapshot, snapshot)


def bucketed_days(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """A row for each day that [start, end] touches: turns a range join into an equi-join with a residual."""
    return df.withColumn("_day", F.explode(F.sequence(start.cast("date"), end.cast("date"))))


def outside(rows: DataFrame, ranges: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Rows whose time lies in no range of their key (closed): an anti-join on key and day with the range as residual."""
    days = bucketed_days(merge(ranges, keys), F.col("s"), F.col("e"))
    left = rows.withColumn("_at_day", F.col(at).cast("date"))
    on = [*(left[k] == days[k] for k in keys), left["_at_day"] == days["_day"], left[at] >= days["s"], left[at] <= days["e"]]
    return left.join(days, on, "left_anti").drop("_at_day")


def contained(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """Inner ranges wholly inside one outer range of the same key."""
    return inner.alias("i").join(
        outer.alias("o"), [*(F.col(f"i.{k}") == F.col(f"o.{k}") for k in keys), F.col("o.s") <= F.col("i.s"), F.col("i.e") <= F.col("o.e")], "left_semi"
    )


def may_commit(complete: Column, errors: Column, keyword: Column, cap: Column) -> Column:
    """Coverage is proof: only a complete, clean, unfiltered and uncapped read may be recorded."""
    return complete & (errors == 0) & keyword.isNull() & cap.isNull()


def watermark(old: Column, new: Column) -> Column:
    return F.greatest(old, new)
