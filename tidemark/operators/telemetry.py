"""Run telemetry: timings, moving averages, peaks, adaptive limits, and what to tune next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.lineage import cut

ALPHA = 0.22


def stage_timings(events: DataFrame, stage: str, seconds: str) -> DataFrame:
    """count, total, average and longest of each stage; sums are exact decimals."""
    exact = F.col(seconds).cast("decimal(18,4)")
    return events.groupBy(stage).agg(
        F.count(F.lit(1)).alias("n"), F.sum(exact).cast("double").alias("total_s"), (F.sum(exact).cast("double") / F.count(F.lit(1))).alias("avg_s"), F.max(exact).cast("double").alias("max_s")
    )


def ewma(events: DataFrame, group: list[str], order: list[str], value: str, alpha: float = ALPHA, block: int = 12) -> DataFrame:
    """Exponentially weighted latency of each group in event order; the first positive sample seeds it, negative ones count as 0.

    With r rows after a sample, it weighs alpha * (1 - alpha)**r, and the seed (1 - alpha)**r: a sum, which needs no fold. Rows are dealt
    and numbered by ranges, a group is summed in blocks of 2**``block`` numbers, and only blocks are put in order within a group.
    (A mean that zeros have worn down below the smallest double isn't seeded anew.)
    """
    v = F.greatest(F.col(value).cast("double"), F.lit(0.0))
    rows = events.select(*group, *[c for c in order if c not in group], v.alias("_v"), F.col(value).alias("_raw"))
    dealt = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    numbered = cut(dealt.withColumn("_id", F.monotonically_increasing_id()), "ewma").withColumn("_block", F.shiftright("_id", block))
    after = F.row_number().over(Window.partitionBy(*group, "_block").orderBy(F.desc("_id"))) - 1
    decay = F.pow(F.lit(1 - alpha), F.col("_r"))
    blocks = numbered.withColumn("_r", after).groupBy(*group, "_block").agg(
        F.sum(alpha * decay * F.col("_v")).alias("_sum"), F.min_by(F.struct("_r", "_v"), F.when(F.col("_v") > 0, F.col("_id"))).alias("_seed"),
        F.count(F.lit(1)).alias("_m"), F.sum("_raw").alias("_total"), F.count("_raw").alias("_known"), F.max("_raw").alias("_most"),
    )
    later = F.sum("_m").over(Window.partitionBy(*group).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_m")
    placed = blocks.withColumn("_later", later).withColumn("_fall", F.pow(F.lit(1 - alpha), F.col("_later")))
    seed = F.min_by(F.col("_seed._v") * F.pow(F.lit(1 - alpha), F.col("_seed._r") + 1) * F.col("_fall"), F.when(F.col("_seed").isNotNull(), F.col("_block")))
    return placed.groupBy(*group).agg(
        (F.sum(F.col("_sum") * F.col("_fall")) + F.coalesce(seed, F.lit(0.0))).alias("ewma"), F.sum("_m").alias("n"), (F.sum("_total") / F.sum("_known")).alias("mean"), F.max("_most").alias("longest")
    )


def peak_active(spans: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """Most spans at once in each group; one that ends as another starts doesn't overlap it."""
    marks = spans.select(*group, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("m"))
    # Equal times are summed first: fewer rows to order, and ends and starts cancel out.
    steps = marks.groupBy(*group, "m.t").agg(F.sum("m.d").alias("d"))
    running = F.sum("d").over(Window.partitionBy(*group).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return steps.withColumn("_a", running).groupBy(*group).agg(F.max("_a").alias("peak"))


def gate_replay(events: DataFrame, group: list[str], order: list[str], kind: str, most: int, per_step: int = 6) -> DataFrame:
    """The adaptive limit after a history of outcomes (ok, throttle, transient, other).

    A throttle halves the limit, a transient fault takes one off, ``per_step`` x limit successes in a row give one back.
    """
    run = F.array_sort(F.collect_list(F.struct(*order, F.col(kind).alias("_k"))))
    zero = F.struct(*[F.lit(v).alias(n) for n, v in (("cap", most), ("streak", 0), ("throttles", 0), ("transients", 0), ("ramps", 0))])

    def step(s: Column, x: Column) -> Column:
        ok, throttle, fault = x["_k"] == "ok", x["_k"] == "throttle", x["_k"] == "transient"
        ramp = ok & (s["cap"] < most) & (s["streak"] + 1 >= per_step * s["cap"])
        cap = F.when(ramp, s["cap"] + 1).when(throttle, F.greatest(F.lit(1), F.floor(s["cap"] / 2).cast("int"))).when(fault, F.greatest(F.lit(1), s["cap"] - 1)).otherwise(s["cap"])
        return F.struct(
            cap.alias("cap"), F.when(ok & ~ramp, s["streak"] + 1).otherwise(0).alias("streak"), (s["throttles"] + throttle.cast("int")).alias("throttles"),
            (s["transients"] + fault.cast("int")).alias("transients"), (s["ramps"] + ramp.cast("int")).alias("ramps"),
        )

    return events.groupBy(*group).agg(F.aggregate(run, zero, step).alias("s")).select(*group, F.col("s.cap").alias("final_limit"), "s.streak", "s.throttles", "s.transients", "s.ramps")


def queue_metrics(events: DataFrame, group: list[str], waited: str, failed: str) -> DataFrame:
    return events.groupBy(*group).agg(
        F.count(F.lit(1)).alias("submitted"), F.count_if(~F.col(failed)).alias("completed"), F.count_if(F.col(failed)).alias("failed"),
        F.sum(F.col(waited).cast("decimal(18,4)")).cast("double").alias("wait_s"), F.max(waited).alias("longest_wait_s"),
    )


def advise(runs: DataFrame) -> DataFrame:
    """``runs`` (one row each: processed, elapsed, llm_max/peak, wait and backlog counters) with ratios, bottleneck and
    next-run settings. The rungs are tried in order; what no rung explains is balanced."""
    ratio = lambda a, b: F.least(F.lit(1.0), F.col(a) / F.greatest(F.lit(1), F.col(b)))
    rows = runs.withColumns({
        "throughput": F.when(F.col("elapsed") > 0, F.col("processed") / F.col("elapsed") * 60.0).otherwise(0.0), "llm_ratio": ratio("llm_peak", "llm_max"),
        "extract_ratio": ratio("extract_peak", "extract_workers"), "backlog_ratio": ratio("inflight_peak", "inflight_max"), "wait_ratio": ratio("waited", "requests"),
    })
    pressed = (F.col("throttles") > 0) | (F.col("limit_now") < F.col("limit_max"))
    bottleneck = (
        F.when(pressed, "provider").when((F.col("wait_ratio") >= 0.25) & (F.col("llm_ratio") >= 0.75), "provider")
        .when((F.col("backlog_ratio") >= 0.85) & (F.col("extract_ratio") >= 0.75), "extraction")
        .when((F.col("llm_ratio") >= 0.95) & (F.col("wait_ratio") < 0.10) & (F.col("llm_max") < 8), "llm-capacity")
        .when((F.col("llm_ratio") < 0.50) & (F.col("backlog_ratio") < 0.50), "preparation-or-source").otherwise("balanced")
    )
    rows = rows.withColumn("bottleneck", bottleneck)
    confidence = F.when(F.col("bottleneck").isin("provider", "extraction"), "high").when((F.col("bottleneck") == "preparation-or-source") & (F.col("processed") < 8), "low").otherwise("medium")
    slots = F.when(pressed, F.greatest(F.lit(1), F.least("llm_max", "limit_now"))).when(F.col("bottleneck") == "llm-capacity", F.col("llm_max") + 1).otherwise(F.col("llm_max"))
    workers = F.when((F.col("bottleneck") == "extraction") & (F.col("extract_workers") < 8), F.col("extract_workers") + 1).otherwise(F.col("extract_workers"))
    return rows.withColumns({"confidence": confidence, "llm_slots": slots, "workers": workers})


def run_state(events: DataFrame, run: str, at: str, kind: str) -> DataFrame:
    """The state a run's last deciding event leaves it in; one that only started is interrupted."""
    last = F.max_by(kind, F.struct(at, kind))
    return events.groupBy(run).agg(last.alias("_k"), F.max(at).alias("last_event"), F.count(F.lit(1)).alias("events")).select(
        run, F.when(F.col("_k").isin("completed", "failed", "partial"), F.col("_k")).otherwise(F.lit("interrupted")).alias("state"), "last_event", "events"
    )
