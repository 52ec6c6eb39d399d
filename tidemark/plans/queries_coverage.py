"""Coverage algebra and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import coverage
from tidemark.plans.registry import announcements, intervals, query

MERGED_SQL = """iv AS (SELECT user_id AS k, ts AS s, ts + INTERVAL 12 HOUR AS e, event_type AS src FROM events),
m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM iv),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) gid FROM m),
c AS (SELECT k, min(s) s, max(e) e FROM g GROUP BY k, gid)"""
REQUEST = "TIMESTAMP '2024-01-05 00:00:00'", "TIMESTAMP '2024-01-20 00:00:00'"
REQUESTS_SQL = f"q AS (SELECT DISTINCT user_id AS k, {REQUEST[0]} AS qs, {REQUEST[1]} AS qe FROM events)"
GAPS_SQL = f"""{MERGED_SQL}, {REQUESTS_SQL}, h AS (SELECT q.*, s, e, lag(e) OVER (PARTITION BY q.k ORDER BY s) pv, lead(s) OVER (PARTITION BY q.k ORDER BY s) nx FROM q JOIN c ON q.k = c.k AND s <= qe AND e >= qs),
gap AS (SELECT k, qs, qe, qs AS gs, s AS ge FROM h WHERE pv IS NULL AND s > qs UNION ALL SELECT k, qs, qe, e, coalesce(nx, qe) FROM h WHERE e < coalesce(nx, qe)
UNION ALL SELECT k, qs, qe, qs, qe FROM q WHERE k NOT IN (SELECT k FROM h))"""


def _requests(t):
    lo, hi = (F.expr(x.replace("TIMESTAMP", "TIMESTAMP_NTZ")) for x in REQUEST)
    return t("events").select(F.col("user_id").alias("k")).distinct().withColumns({"qs": lo, "qe": hi})


@query(f"WITH {MERGED_SQL} SELECT k, s, e FROM c")
def coverage_merge(t, spark, sf):
    """H1, F3"""
    return coverage.merge(intervals(t), ["k"]).select("k", "s", "e")


@query(f"WITH {GAPS_SQL} SELECT * FROM gap")
def coverage_gaps(t, spark, sf):
    """H2, F4"""
    return coverage.subtract(_requests(t), intervals(t), ["k"])


@query(f"WITH {GAPS_SQL} SELECT k, gs, ge, greatest(qs, gs - INTERVAL 1 DAY) AS read_from, least(ge, TIMESTAMP '2024-01-12') AS read_to, CASE WHEN ge > TIMESTAMP '2024-01-12' THEN TIMESTAMP '2024-01-12' END AS deferred_from FROM gap")
def coverage_read_plan(t, spark, sf):
    """H3, H4"""
    snap = F.expr("TIMESTAMP_NTZ '2024-01-12'")
    gaps = coverage.widen(coverage.subtract(_requests(t), intervals(t), ["k"]), 1.0)
    return gaps.select("k", "gs", "ge", "read_from", coverage.pollable(F.col("ge"), snap).alias("read_to"), coverage.deferred(F.col("ge"), snap).alias("deferred_from"))


@query(f"""WITH {MERGED_SQL}, l AS (SELECT k, gid, min(s) AS s, max(e) AS e, max((src = 'purchase')::INT) AS has_new, max_by(src, (s, e, src)) AS last_src FROM g GROUP BY k, gid)
SELECT k, s, e, CASE WHEN has_new = 1 THEN 'purchase' ELSE last_src END AS src FROM l""")
def coverage_commit_sources(t, spark, sf):
    """The label of a merged block"""
    return coverage.merge_labelled(intervals(t), ["k"], "src", "purchase")


@query(f"""WITH iv AS (SELECT user_id AS k, ts AS s, ts + INTERVAL 12 HOUR AS e FROM events WHERE event_id % 4 <> 0), p AS (SELECT event_id, user_id AS k, ts FROM events WHERE event_id % 4 = 0)
SELECT event_id, k, ts FROM p WHERE ts BETWEEN {REQUEST[0]} AND {REQUEST[1]} AND NOT EXISTS (SELECT 1 FROM iv WHERE iv.k = p.k AND p.ts BETWEEN s AND e)""")
def trusted_history_filter(t, spark, sf):
    """C1, C3"""
    ev = t("events").select("event_id", F.col("user_id").alias("k"), "ts")
    known = ev.where("event_id % 4 <> 0").select("k", F.col("ts").alias("s"), F.expr("ts + interval 12 hours").alias("e"))
    lo, hi = (F.expr(x.replace("TIMESTAMP", "TIMESTAMP_NTZ")) for x in REQUEST)
    return coverage.outside(ev.where("event_id % 4 = 0").where(F.col("ts").between(lo, hi)), known, ["k"], "ts").select("event_id", "k", "ts")


@query("""WITH iv AS (SELECT user_id AS k, event_id, ts AS s, ts + (event_id % 36) * INTERVAL 1 HOUR AS e FROM events)
SELECT a.k, a.event_id FROM iv a WHERE a.event_id % 2 = 1 AND EXISTS (SELECT 1 FROM iv b WHERE b.event_id % 2 = 0 AND b.k = a.k AND b.s <= a.s AND a.e <= b.e)""")
def coverage_contained(t, spark, sf):
    """D18"""
    iv = t("events").select(F.col("user_id").alias("k"), "event_id", F.col("ts").alias("s"), F.expr("ts + make_dt_interval(0, cast(event_id % 36 as int))").alias("e"))
    return coverage.contained(iv.where("event_id % 2 = 1"), iv.where("event_id % 2 = 0"), ["k"]).select("k", "event_id")


@query("""SELECT event_type AS scope, count(*) AS n, min(ts) AS s, max(ts) AS e, greatest(max(ts) FILTER (WHERE event_id % 2 = 0), max(ts) FILTER (WHERE event_id % 2 = 1)) AS watermark,
(count(*) FILTER (WHERE value < 0) = 0) AS committed FROM events GROUP BY 1""")
def coverage_commit(t, spark, sf):
    """U17, B7"""
    facts = t("events").groupBy(F.col("event_type").alias("scope")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("s"), F.max("ts").alias("e"), F.max(F.when(F.col("event_id") % 2 == 0, F.col("ts"))).alias("_old"),
        F.max(F.when(F.col("event_id") % 2 == 1, F.col("ts"))).alias("_new"), F.count_if(F.col("value") < 0).alias("_errors"),
    )
    nothing = F.lit(None).cast("string")
    return facts.select("scope", "n", "s", "e", coverage.watermark(F.col("_old"), F.col("_new")).alias("watermark"), coverage.may_commit(F.lit(True), F.col("_errors"), nothing, nothing).alias("committed"))


@query("SELECT o_orderkey AS id2, o_custkey AS ticker FROM orders WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = o_orderkey AND quality = 1)")
def already_complete_filter(t, spark, sf):
    """C4"""
    done = t("labels").where("quality = 1").select(F.col("doc_id").alias("id2"))
    return announcements(t).select("id2", "ticker").join(done, "id2", "left_anti")


@query("SELECT o_orderkey AS id2, o_custkey AS ticker FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def allowlist_filter(t, spark, sf):
    """C5, A6"""
    listed = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("ticker"))
    return announcements(t).select("id2", "ticker").join(listed, "ticker", "left_semi").select("id2", "ticker")


@query("SELECT DISTINCT o_custkey AS ticker FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def hidden_tickers(t, spark, sf):
    """C22, H6"""
    listed = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("ticker"))
    return announcements(t).select("ticker").distinct().join(listed, "ticker", "left_anti")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE try_cast(json_extract_string(props, '$.k') AS INT) IS NOT NULL")
def bad_value_isolation(t, spark, sf):
    """Rows whose value doesn't parse go to the error side"""
    return t("events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k")).where("k is not null")


@query("""SELECT o_orderkey AS id2, strftime(o_orderdate, '%Y-%m-%d') || ' → ' || strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS label, strftime(o_orderdate, '%Y%m%d') || '-to-' || strftime(o_orderdate + INTERVAL 7 DAY, '%Y%m%d') AS scope,
date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS day_end FROM orders""")
def boundary_labels(t, spark, sf):
    """I1-I4"""
    from tidemark.functions import times

    start, end = F.date_trunc("day", "announced_at").cast("timestamp_ntz"), F.expr("cast(date_trunc('day', announced_at) as timestamp_ntz) + interval 7 days")
    return announcements(t).select(
        "id2", times.window_label(times.iso(start), times.iso(end)).alias("label"), times.date_scope(start, end).alias("scope"),
        times.parse_boundary(F.date_format("announced_at", "yyyy-MM-dd"), end=True).alias("day_end"),
    )
