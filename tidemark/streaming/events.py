"""Streams over the event log: cursor reads, deduplication, event-time windows and stateful folds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, like: DataFrame, files: int = 16) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Drain what there is into Parquet, exactly once per batch, and read it back."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/table/b={number}")

    sink = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/log").trigger(availableNow=True)
    sink.foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{path}/table").drop("b")


def after_cursor(events: DataFrame, run: str, seq: str, cursors: DataFrame) -> DataFrame:
    """Events past each run's cursor; a run without one is read from its start."""
    return events.join(cursors, run, "left").where(F.col(seq) > F.coalesce("cursor", F.lit(-1))).drop("cursor")


def unique_events(stream: DataFrame, at: str, key: str, late: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def tumbling_counts(stream: DataFrame, at: str, width: str, late: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start_at"), F.col("window.end").alias("end_at"), "n")


def ewma_stream(stream: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.22) -> DataFrame:
    """Running exponentially weighted mean of each key, with the number of samples; state is two numbers a key."""

    def fold(keys: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, n = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        for v in rows[value].tolist():
            v = max(0.0, v)
            mean, n = (v if mean <= 0 else alpha * v + (1 - alpha) * mean), n + 1
        state.update((mean, n))
        yield pd.DataFrame({key: [keys[0]], "ewma": [mean], "n": [n]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(
        fold, f"{key} {kind}, ewma double, n long", "ewma double, n long", "update", GroupStateTimeout.NoTimeout
    )
