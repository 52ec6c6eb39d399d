"""Streams with state, cursors and replayable sinks, over the event table written as files in several pieces."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.lineage import folder
from tidemark.operators.store import VersionedStore
from tidemark.plans.registry import query
from tidemark.streaming import events as streams
from tidemark.streaming import stateful

PIECES = 4


def _room(spark, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def _pieces(events: DataFrame, path: str) -> int:
    """``events`` as files that come one after the other: by days, a third of the rows one piece late. As many tasks write a piece as
    read the table; how many files a piece has is returned, so that a batch can take a piece whatever its size."""
    piece = F.pmod(F.floor(F.dayofyear("ts") / 8) + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0), F.lit(PIECES))
    marked = events.withColumn("_piece", piece.cast("int"))
    for k in range(PIECES):
        marked.where(F.col("_piece") == k).drop("_piece").write.mode("append").parquet(path)
    return max(1, -(-len(events.sparkSession.read.schema(events.schema).parquet(path).inputFiles()) // PIECES))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1""")
def stream_latest(t, spark, sf):
    """The progressive latest row of each key, batches out of order"""
    room = _room(spark, "latest")
    files = _pieces(t("events"), f"{room}/in")
    rows = streams.read_stream(spark, f"{room}/in", t("events"), files=files)
    rows = rows.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "event_type", "value")
    store = VersionedStore(spark, f"{room}/store", ["user_id"])
    stateful.upsert_stream(stateful.latest_stream(rows, "user_id", ["at", "event_id"]), store, f"{room}/log", [F.desc("at"), F.desc("event_id")], mode="update")
    return store.read().select("user_id", "event_type", "value", "event_id")


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 0 WHEN 'view' THEN 0 END AS f FROM events), s AS (SELECT * FROM e WHERE f IS NOT NULL),
l AS (SELECT *, lag(f, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s),
r AS (SELECT user_id, run, sum(f) AS n, max(run) OVER (PARTITION BY user_id) AS last FROM l GROUP BY user_id, run),
t AS (SELECT user_id, sum(CASE WHEN f = 1 AND before = 0 THEN 1 ELSE 0 END)::BIGINT AS outages, sum(CASE WHEN f = 0 AND before = 1 THEN 1 ELSE 0 END)::BIGINT AS recoveries, arg_max(f, (ts, event_id)) = 1 AS down FROM l GROUP BY 1),
g AS (SELECT user_id, max(n)::BIGINT AS longest, max(CASE WHEN run = last THEN n END)::BIGINT AS streak FROM r GROUP BY 1)
SELECT c.user_id, coalesce(down, false) AS down, coalesce(outages, 0) AS outages, coalesce(recoveries, 0) AS recoveries, coalesce(streak, 0) AS streak, coalesce(longest, 0) AS longest, c.seen
FROM (SELECT user_id, count(*) AS seen FROM events GROUP BY 1) c LEFT JOIN t USING (user_id) LEFT JOIN g USING (user_id)""")
def stream_outages(t, spark, sf):
    """Outages and failure streaks as state; late rows are put in order across batches. The stream is stopped and taken up again
    by a second run over its checkpoint, which also brings a row that moves the watermark past all others."""
    room, events = _room(spark, "outages"), t("events")
    files = _pieces(events, f"{room}/in")
    store = VersionedStore(spark, f"{room}/store", ["user_id"])

    def run() -> None:
        rows = streams.read_stream(spark, f"{room}/in", events, files=files)
        folded = stateful.outage_stream(rows, "user_id", "ts", "event_id", "event_type", ["error"], ["purchase", "view"], late="40 days")
        stateful.upsert_stream(folded, store, f"{room}/log", [F.desc("seen")], mode="update")

    run()
    end = events.agg(F.max("ts").alias("ts")).select("ts").where("ts is not null")
    tail = end.select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("interval 60 days")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props"))
    tail.select(*events.columns).coalesce(1).write.mode("append").parquet(f"{room}/in")
    run()
    return store.read().where("user_id >= 0")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY user_id) AS total FROM events)
SELECT 'run-' || user_id AS run_id, seq, CASE WHEN seq = total THEN 'done' ELSE 'update' END AS event FROM n WHERE seq = total OR (seq > CASE WHEN user_id % 2 = 0 THEN 3 ELSE -1 END AND seq % 11 <> 5)""")
def stream_run_log(t, spark, sf):
    """JSON lines with broken ones among them, read as a stream past each reader's cursor up to the end of the run. Two runs over
    one checkpoint, the second after more files came, read every line once."""
    from pyspark.sql import Window

    room = _room(spark, "runlog")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = t("events").withColumns({"seq": F.row_number().over(by).cast("long"), "total": F.count(F.lit(1)).over(Window.partitionBy("user_id"))})
    ends = F.col("seq") == F.col("total")
    line = F.struct(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"), "seq", F.when(ends, "status").otherwise("event").alias("type"), F.col("event_type").alias("stage"), F.when(ends, "completed").alias("status"))
    whole = F.to_json(line)
    text = n.select("seq", "total", F.when((F.col("seq") % 11 == 5) & ~ends, F.substring(whole, 1, 20)).otherwise(whole).alias("value"))
    cursors = t("events").where("user_id % 2 = 0").select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"), F.lit(3).alias("cursor")).distinct()
    halves = [F.col("seq") <= F.col("total") / 2, F.col("seq") > F.col("total") / 2]
    for half in halves:
        text.where(half).select("value").write.mode("append").text(f"{room}/in")
        out = streams.run_to_table(stateful.past_cursor(stateful.log_stream(spark, f"{room}/in"), cursors), f"{room}/out")
    return out.select("run_id", "seq", "event")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS batches_rows FROM events GROUP BY 1")
def stream_replay(t, spark, sf):
    """L4, B1: a keyed upsert a batch; after the first run every batch is sent again, as after a lost commit, and changes nothing"""
    room, events = _room(spark, "replay"), t("events")
    files = _pieces(events, f"{room}/in")
    store = VersionedStore(spark, f"{room}/store", ["user_id"])

    def drain(log: str) -> None:
        rows = streams.read_stream(spark, f"{room}/in", events, files=files).select("user_id", "ts", "event_id", "event_type", F.lit(1).cast("long").alias("n"))

        def write(batch: DataFrame, number: int) -> None:
            known = store.read()
            every = batch if known is None else batch.unionByName(known.select("user_id", "ts", "event_id", "event_type", F.col("batches_rows").alias("n")))
            last = F.struct("ts", "event_id")
            new = every.groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_id", last).alias("event_id"), F.max_by("event_type", last).alias("event_type"), F.sum("n").alias("batches_rows"))
            store.merge(new, batch=number)

        rows.writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()

    drain(f"{room}/log")
    drain(f"{room}/log-lost")
    return store.read().select("user_id", "event_type", "event_id", "batches_rows")
