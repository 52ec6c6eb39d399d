"""Queries by name, each with the SQL that says the same (or none)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of (t, spark), ``t(name)`` being a table, under its own name."""

    def take(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark, sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return take


# How the test tables stand in for the engine's own -----------------------------------------------------------------


def announcements(t) -> DataFrame:
    """orders as announcements: id2, ticker, announced_at, title, status."""
    return t("orders").select(
        F.col("o_orderkey").alias("id2"), F.col("o_custkey").alias("ticker"), F.col("o_orderdate").alias("announced_at"), F.col("o_orderpriority").alias("title"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"),
    )


def attachments(t) -> DataFrame:
    """lineitem as attachments of orders, with file names made from the flags."""
    kind = (
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "Laporan_Keuangan-").when(F.col("l_returnflag") == "R", "FinancialStatement ")
        .when(F.col("l_partkey") % 7 == 0, "Checklist ").otherwise("Lampiran ")
    )
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".xlsx", ".zip", ".PDF", ".exe", ".docx")]), (F.col("l_suppkey") % 6 + 1).cast("int"))
    return t("lineitem").select(
        F.col("l_orderkey").alias("announcement_id"), F.col("l_linenumber").alias("position"), (F.col("l_linenumber") > 1).alias("is_attachment"),
        F.concat(kind, F.col("l_partkey").cast("string"), suffix).alias("filename"), F.col("l_extendedprice").alias("size"),
    )


ATTACHMENTS_SQL = """att AS (SELECT l_orderkey AS announcement_id, l_linenumber AS position, l_linenumber > 1 AS is_attachment,
  CASE WHEN l_returnflag='A' AND l_linestatus='F' THEN 'Laporan_Keuangan-' WHEN l_returnflag='R' THEN 'FinancialStatement '
       WHEN l_partkey % 7 = 0 THEN 'Checklist ' ELSE 'Lampiran ' END || l_partkey ||
  (['.pdf','.xlsx','.zip','.PDF','.exe','.docx'])[l_suppkey % 6 + 1] AS filename FROM lineitem)"""


def windows(t) -> DataFrame:
    """Saved windows: month and quarter windows of each company's orders, with when they were written."""
    o = announcements(t)

    def cut(unit: str, months: int) -> DataFrame:
        start = F.date_trunc(unit, "announced_at").cast("timestamp_ntz")
        w = o.select("ticker", start.alias("start_at"), "announced_at", "amount")
        w = w.groupBy("ticker", "start_at").agg(F.count(F.lit(1)).alias("n"), F.max("announced_at").alias("updated_at"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"))
        return w.withColumn("end_at", F.expr(f"start_at + interval {months} months - interval 1 second"))

    return cut("month", 1).unionByName(cut("quarter", 3)).select("ticker", "start_at", "end_at", "updated_at", "n", "amount")


WINDOWS_SQL = """w AS (SELECT ticker, start_at, start_at + m * INTERVAL 1 MONTH - INTERVAL 1 SECOND AS end_at, updated_at, n, amount FROM (
  SELECT o_custkey AS ticker, date_trunc('month', o_orderdate)::TIMESTAMP AS start_at, 1 AS m, max(o_orderdate) AS updated_at, count(*) AS n,
         sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS amount FROM orders GROUP BY ALL
  UNION ALL
  SELECT o_custkey, date_trunc('quarter', o_orderdate)::TIMESTAMP, 3, max(o_orderdate), count(*), sum(o_totalprice::DECIMAL(18,2))::DOUBLE FROM orders GROUP BY ALL))"""


def intervals(t) -> DataFrame:
    """Coverage of each user: twelve hours from every event."""
    return t("events").select(F.col("user_id").alias("k"), F.col("ts").alias("s"), F.expr("ts + interval 12 hours").alias("e"), F.col("event_type").alias("src"))
