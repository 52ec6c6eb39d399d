"""Folds with state in RocksDB: the latest value of a key, outages in event-time order, keyed upserts that can be replayed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.operators.store import VersionedStore

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State variables, lists and timers need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Latest(StatefulProcessor):
    """A ValueState a key: the row that is last by ``order``. A row that is not newer changes and tells nothing."""

    def __init__(self, schema: StructType, order: list[str]) -> None:
        self.schema, self.order = schema, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.best.get() if self.best.exists() else None
        place = [self.schema.names.index(c) for c in self.order]
        best = held
        for frame in rows:
            at = int(np.lexsort([frame[c].to_numpy() for c in reversed(self.order)])[-1]) if len(frame) > 1 else 0
            top = tuple(frame[c].iat[at] for c in self.schema.names)
            if best is None or tuple(top[p] for p in place) > tuple(best[p] for p in place):
                best = top
        if best is not held:
            values = tuple(v.item() if hasattr(v, "item") else v for v in best)
            self.best.update(values)
            yield pd.DataFrame([values], columns=self.schema.names)

    def close(self) -> None:
        pass


def latest_stream(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The progressive latest row of each ``key`` by ``order`` (columns of integers or text), told whenever it changes, whatever
    order the rows come in."""
    use_rocksdb(stream.sparkSession)
    fold = Latest(stream.schema, order)
    return stream.groupBy(key).transformWithStateInPandas(fold, stream.schema, "Update", "None")


class Outages(StatefulProcessor):
    """Outages and failure streaks of a key in event-time order.

    Rows wait in a ListState until the watermark has passed them, so a row that comes late, in a later batch, still takes its
    place. A timer a key stands at the first row that waits; when it fires, the rows that the watermark has passed are folded in
    order and the next timer is set. Failure while up begins an outage, success while down ends it; other kinds say nothing.
    """

    WAITING = "at_us long, id long, kind string"
    TOTALS = "down boolean, outages long, recoveries long, streak long, longest long, seen long, last_us long"

    def __init__(self, key: str, failures: list[str], successes: list[str]) -> None:
        self.key, self.failures, self.successes = key, set(failures), set(successes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.totals = handle.getValueState("totals", self.TOTALS)

    def _wake(self, rows: list[tuple]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rows:
            self.handle.registerTimer(min(r[0] for r in rows) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = [(int(a), int(i), str(k)) for frame in rows for a, i, k in zip(frame["at_us"], frame["id"], frame["kind"])]
        self.waiting.appendList(new)
        first = min(r[0] for r in new) // 1000 + 1
        set_at = [int(t) for t in self.handle.listTimers()]
        if not set_at or first < min(set_at):
            for timer in set_at:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        ripe = [r for r in rows if r[0] // 1000 + 1 <= passed]
        rest = rows[len(ripe) :]
        down, outages, recoveries, streak, longest, seen, last = self.totals.get() if self.totals.exists() else (False, 0, 0, 0, 0, 0, 0)
        for at, _, kind in ripe:
            if kind in self.failures:
                outages, down, streak = outages + (not down), True, streak + 1
                longest = max(longest, streak)
            elif kind in self.successes:
                recoveries, down, streak = recoveries + down, False, 0
            seen, last = seen + 1, at
        self.totals.update((bool(down), outages, recoveries, streak, longest, seen, last))
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
        self._wake(rest)
        yield pd.DataFrame([(key[0], bool(down), outages, recoveries, streak, longest, seen)], columns=[self.key, "down", "outages", "recoveries", "streak", "longest", "seen"])

    def close(self) -> None:
        pass


def outage_stream(stream: DataFrame, key: str, at: str, event: str, kind: str, failures: list[str], successes: list[str], late: str) -> DataFrame:
    """down, outages, recoveries, streak, longest and seen of each ``key`` as far as the watermark (``late`` behind the newest row) has
    come. A row later than that is lost to the fold, so ``late`` is the longest delay that the source promises."""
    use_rocksdb(stream.sparkSession)
    zoned = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    rows = zoned.select(key, "_at", F.unix_micros("_at").alias("at_us"), F.col(event).cast("long").alias("id"), F.col(kind).alias("kind"))
    out = f"{key} {dict(stream.dtypes)[key]}, down boolean, outages long, recoveries long, streak long, longest long, seen long"
    return rows.groupBy(key).transformWithStateInPandas(Outages(key, failures, successes), out, "Update", "EventTime")


def upsert_stream(stream: DataFrame, store: VersionedStore, log: str, order: list | None = None, mode: str = "append") -> None:
    """Drain what there is into ``store``, a keyed upsert a batch. The store's pointer names the last batch, so a batch that is
    replayed after a failure, before or after its version was published, changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        store.merge(batch, order, batch=number)

    sink = stream.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True)
    sink.foreachBatch(write).start().awaitTermination()


LOG_LINE = "run_id string, seq long, type string, stage string, status string, bad string"


def log_stream(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    """run_id, seq, event and data of run logs as they grow (JSON lines in files under ``path``): ``update`` for each event, ``done`` for
    the line that ends a run. Lines that don't parse, or name no run or place, are passed over."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    read = lines.select("value", F.from_json("value", LOG_LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}).alias("r"))
    ends = F.coalesce((F.col("r.type") == "status") & F.col("r.status").isin("completed", "partial", "failed", "interrupted"), F.lit(False))
    fine = F.col("r.bad").isNull() & F.col("r.run_id").isNotNull() & F.col("r.seq").isNotNull()
    return read.where(fine).select("r.run_id", "r.seq", F.when(ends, "done").otherwise("update").alias("event"), F.col("value").alias("data"))


def past_cursor(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """``events`` (a stream or a table of ``log_stream``'s columns) that a reader has not had; a run's end is told in any case."""
    return events.join(cursors, "run_id", "left").where((F.col("event") == "done") | (F.col("seq") > F.coalesce("cursor", F.lit(-1)))).drop("cursor")
