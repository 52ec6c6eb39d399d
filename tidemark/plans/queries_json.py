"""JSON sources, workbook grids, console filter and the audit of a company."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import flow
from tidemark.plans.registry import announcements, query
from tidemark.sources import json_scan


@query("""SELECT DISTINCT 'C' || c_custkey AS ticker FROM customer WHERE c_custkey % 3 <> 2 UNION SELECT DISTINCT 'SEG-' || c_nationkey FROM customer WHERE c_custkey % 3 = 2""")
def security_list(t, spark, sf):
    """Three payload shapes"""
    key = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    payload = (
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('{"Results": [{"KodeEmiten": " '), key, F.lit(' "}, {"Code": "much-too-long"}]}')))
        .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit('["'), key, F.lit('", "?"]')))
        .otherwise(F.concat(F.lit('{"seg-'), F.col("c_nationkey").cast("string"), F.lit('": {"name": "x"}}')))
    )
    return json_scan.tickers(t("customer").select(payload.alias("payload")))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, max(turn) AS total_tokens FROM conversations WHERE turn < 4 GROUP BY 1")
def sse_parse(t, spark, sf):
    """Deltas in order up to the end mark, with the last usage"""
    c = t("conversations")
    data = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"), F.struct(F.col("turn").alias("total_tokens")).alias("usage")))
    lines = c.select("conv_id", "turn", F.when(F.col("turn") == 4, "data: [DONE]").otherwise(F.concat(F.lit("data: "), data)).alias("line"))
    out = json_scan.sse_text(lines, "conv_id", "turn")
    return out.select("conv_id", "text", F.col("total_tokens").cast("long").alias("total_tokens"))


@query("""SELECT l_orderkey AS sheet, l_linenumber AS row, l_partkey AS col, CASE WHEN l_discount > 0.05 AND l_tax > 0.04 THEN '[FORMULA_NO_CACHED_VALUE: =Q' || l_suppkey || ']' WHEN l_discount > 0.05 THEN NULL ELSE l_returnflag END AS value
FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey) = 1""")
def formula_grid(t, spark, sf):
    """D17"""
    from pyspark.sql import Window

    at = [F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row"), F.col("l_partkey").alias("col")]
    one = t("lineitem").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey", "l_linenumber", "l_partkey"))).where("_n = 1")
    values = one.select(*at, F.when(F.col("l_discount") <= 0.05, F.col("l_returnflag")).alias("value"))
    formulas = one.select(*at, F.when(F.col("l_tax") > 0.04, F.concat(F.lit("=Q"), F.col("l_suppkey").cast("string"))).otherwise("x").alias("value"))
    return json_scan.joined_grid(values, formulas)


@query("""SELECT event_id, event_type = 'error' OR (event_type <> 'view') AS shown FROM events""")
def console_filter(t, spark, sf):
    """C19"""
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    stage = F.when(F.col("event_type") == "view", "cache").otherwise(F.col("event_type"))
    return t("events").select("event_id", json_scan.printed(level, stage, F.lit("m"), True, False, True, True).alias("shown"))


@query("""WITH a AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7) SELECT 'announced' AS kind, o_orderdate AS at, o_orderkey::VARCHAR AS ref FROM a
UNION ALL SELECT 'fetched', l_shipdate, 'u' || l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM a)
UNION ALL SELECT 'summarized', NULL, doc_id::VARCHAR FROM labels WHERE doc_id IN (SELECT o_orderkey FROM a) UNION ALL SELECT 'model call', ts, event_id::VARCHAR FROM events WHERE event_id IN (SELECT o_orderkey FROM a)""")
def company_audit(t, spark, sf):
    """D4, D5, U13, G3"""
    a = announcements(t).where("ticker = 7").select("id2", "announced_at")
    att = t("lineitem").select(F.col("l_orderkey").alias("announcement_id"), F.col("l_shipdate").alias("downloaded_at"), F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("url"))
    sums = t("labels").select(F.col("doc_id").alias("announcement_id"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    calls = t("events").select(F.col("event_id").alias("announcement_id"), F.col("ts").alias("started_at"), F.col("event_id").alias("audit_id"))
    return flow.company_audit(a, att, sums, calls)


@query("""SELECT o_custkey AS ticker, count(*) AS announcements, count(doc_id) AS summarized FROM orders LEFT JOIN (SELECT DISTINCT doc_id FROM labels) ON doc_id = o_orderkey WHERE o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-12-31' GROUP BY 1""")
def recovery_snapshot(t, spark, sf):
    """E6, U16"""
    from datetime import datetime

    done = t("labels").select(F.col("doc_id").alias("announcement_id")).distinct()
    return flow.recovery_snapshot(announcements(t), done, datetime(1994, 1, 1), datetime(1996, 12, 31))
