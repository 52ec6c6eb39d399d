"""a table read by several tasks is written by as many, and the stream takes a piece a batch."""

from __future__ import annotations


def test_f13_f15_pieces_of_several_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.plans.queries_streams import PIECES, _pieces
    from tidemark.streaming import events as streams
    from tidemark.streaming import stateful

    rows = spark.range(600, numPartitions=3).select(F.col("id").alias("event_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("make_dt_interval(cast(id % 32 as int), 0, cast(id % 7 as int))")).alias("ts"), (F.col("id") % 9).alias("user_id"))
    assert _pieces(rows, f"{tmp_path}/in") == 3
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 3 * PIECES
    stream = streams.read_stream(spark, f"{tmp_path}/in", rows, files=3).select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    told = streams.run_to_table(stateful.latest_stream(stream, "user_id", ["at", "event_id"]), f"{tmp_path}/out", mode="update")
    assert told.agg(F.max("_batch")).first()[0] < PIECES
    got = {r.user_id: r.last for r in told.groupBy("user_id").agg(F.max_by("event_id", F.struct("at", "event_id")).alias("last")).collect()}
    assert got == {r.user_id: r.last for r in rows.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last")).collect()}
