"""Orders, sequence numbers, fair dispatch and freshness, each inside its own key: no query sorts a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many jobs of a stage go for one of the next.
STAGE_WEIGHTS = {"announcement": 3, "chunk": 2, "company": 1}


def placed(rows: DataFrame, key: list[str], order: list, name: str = "position") -> DataFrame:
    """``rows`` with their place (from 1) inside their key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long"))


def fair_rounds(jobs: DataFrame, ticker: str, stage: str, order: list, weights: dict[str, int] | None = None) -> DataFrame:
    """``jobs`` with ``round``: in each, a ticker has as many jobs of a stage as the stage's weight; run by round, then ticker."""
    weights = weights or STAGE_WEIGHTS
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col(stage)]
    return placed(jobs, [ticker, stage], order, "_n").withColumn("round", F.floor((F.col("_n") - 1) / F.coalesce(weight, F.lit(1))).cast("long")).drop("_n")


def fresh(cache: DataFrame, at: str, hours: float, now: Column) -> DataFrame:
    """Cached rows no older than the time to live; a row without a time is stale."""
    return cache.where((now.cast("double") - F.col(at).cast("timestamp").cast("double")) <= hours * 3600)


def staleness(last: Column, now: Column) -> Column:
    """Seconds since the last event, never below 0; null if there is none."""
    return F.greatest(F.lit(0).cast("long"), F.unix_timestamp(now) - F.unix_timestamp(last))


def window_or_full_day(wanted: DataFrame, saved: DataFrame, key: list[str]) -> DataFrame:
    """``wanted`` (key, end_at) with the saved value of that very end or else, where it ends at 23:59, of the day's last second."""
    exact = saved.select(*key, "end_at", F.col("value").alias("_exact"))
    late = saved.select(*key, F.col("end_at").alias("_end"), F.col("value").alias("_late"))
    full = F.when(F.date_format("end_at", "HH:mm:ss") == "23:59:00", F.col("end_at") + F.expr("interval 59 seconds"))
    return (
        wanted.withColumn("_end", full).join(exact, [*key, "end_at"], "left").join(late, [*key, "_end"], "left")
        .select(*key, "end_at", F.coalesce("_exact", "_late").alias("value"))
    )


def pair_up(a: Column, b: Column, first: str, second: str) -> Column:
    """Two arrays as pairs by place; the longer one's rest is left out."""
    return F.transform(F.slice(F.arrays_zip(a.alias("x"), b.alias("y")), F.lit(1), F.least(F.size(a), F.size(b))), lambda p: F.struct(p["x"].alias(first), p["y"].alias(second)))


def without_suppressed(summaries: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Cached summaries of what has no suppressed document: a suppression makes its announcement's summary void."""
    return summaries.join(documents.where("suppressed").select(key).distinct(), key, "left_anti")


def reported_total(*candidates: Column) -> Column:
    """The first count of a fallback chain that is neither null nor zero; 0 if none is."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in candidates], F.lit(0)).cast("long")
