"""Streams with state and the store they write: replays, lateness, broken lines, restarts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.operators.store import VersionedStore
from tidemark.streaming import events as streams
from tidemark.streaming import stateful


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_batch_merges_once(spark, tmp_path):
    store = VersionedStore(spark, f"file://{tmp_path}/s", ["k"])
    assert store.read() is None
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    two = spark.createDataFrame([(2, "c")], "k int, v string")
    store.merge(one, batch=0)
    store.merge(two, batch=1)
    before = store._last()
    store.merge(one, batch=0)  # sent again
    store.merge(one, batch=1)
    assert store._last() == before and rows(store.read()) == [(1, "a"), (2, "c")]
    one.write.parquet(f"file://{tmp_path}/s/v-orphan")  # a failure after the version, before the pointer
    assert rows(store.read()) == [(1, "a"), (2, "c")]
    store.merge(spark.createDataFrame([(3, "z")], "k int, v string"))  # no stream's batch
    store.merge(one, batch=1)
    assert rows(store.read()) == [(1, "a"), (2, "c"), (3, "z")] and store._last()[2] == 1


def test_outages_wait_for_the_watermark(spark, tmp_path):
    kinds = ["error", "ok", "error", "error", "other", "ok", "error", "error", "error"]
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)
    all_rows = spark.createDataFrame([(i, "p", k) for i, k in enumerate(kinds)], "id long, k string, kind string").withColumn("ts", at)
    for ids in ([6, 2, 0], [8, 1, 3], [7, 5, 4]):
        all_rows.where(F.col("id").isin(ids)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = VersionedStore(spark, f"file://{tmp_path}/store", ["k"])

    def run():
        stream = streams.read_stream(spark, f"{tmp_path}/in", all_rows, files=1)
        out = stateful.outage_stream(stream, "k", "ts", "id", "kind", ["error"], ["ok"], late="1 hour")
        stateful.upsert_stream(out, store, f"{tmp_path}/log", [F.desc("seen")], mode="update")

    run()
    assert store.read() is None or store.read().count() == 0  # nothing is older than the watermark yet
    spark.createDataFrame([(99, "end", "x")], "id long, k string, kind string").withColumn("ts", F.timestamp_seconds(F.lit(1_800_000_000))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert rows(store.read().where("k = 'p'")) == [("p", True, 3, 2, 3, 3, 9)]


def test_log_stream_passes_over_broken_lines(spark, tmp_path):
    lines = [json.dumps({"run_id": "r", "seq": k, "type": "event"}) for k in range(4)]
    lines[1:1] = ["{broken", "", "[]", json.dumps({"seq": 9}), json.dumps({"run_id": "r"})]
    lines.append(json.dumps({"run_id": "r", "seq": 4, "type": "status", "status": "running"}))
    lines.append(json.dumps({"run_id": "r", "seq": 5, "type": "status", "status": "failed"}))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    cursors = spark.createDataFrame([("r", 2)], "run_id string, cursor int")
    out = streams.run_to_table(stateful.past_cursor(stateful.log_stream(spark, f"{tmp_path}/in"), cursors), f"{tmp_path}/out")
    assert rows(out.select("seq", "event")) == [(3, "update"), (4, "update"), (5, "done")]
