"""Provenance, telemetry, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.text import upper_each
from tidemark.operators import provenance, telemetry
from tidemark.plans.registry import announcements, query
from tidemark.sources import extract, paged
from tidemark.streaming import events as streams

STOP_SQL = "['yang','dan','atau','dari','pada','untuk','dengan','dalam','ini','itu','the','and','for','from','with','this','that','sebagai','akan','telah','oleh','serta','atas','are']"


@query(f"""WITH c AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9._%/-]*'), lambda w: length(w) > 2 AND NOT list_contains({STOP_SQL}, w))) AS t FROM benchmark),
s AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9._%/-]*'))) AS tok FROM documents),
m AS (SELECT item_id, doc_id, count(*) / max(len(t)) AS score FROM (SELECT item_id, t, unnest(t) AS tok FROM c) x JOIN s USING (tok) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS rank, max(score) OVER (PARTITION BY item_id) AS best FROM m)
SELECT item_id, doc_id, score, rank FROM r WHERE (rank = 1 AND score >= 0.2) OR (rank = 2 AND best >= 0.2 AND score >= greatest(0.2, best - 0.08))""")
def claim_match_top2(t, spark, sf):
    """D13, I7, I8, U12"""
    out = provenance.match_sources(t("benchmark").select("item_id", "text"), t("documents").select("doc_id", "text"), "item_id", "doc_id")
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("""WITH x AS (SELECT conv_id, list(turn ORDER BY turn) AS ids, CASE WHEN conv_id % 3 = 0 THEN [1] ELSE [0, 2, 9] END AS known FROM conversations GROUP BY 1)
SELECT conv_id, array_to_string(CASE WHEN len(list_filter(ids, lambda i: list_contains(known, i))) = 0 AND len(known) = 1 THEN known ELSE list_filter(ids, lambda i: list_contains(known, i)) END, ',') AS sources FROM x""")
def claim_sources_filter(t, spark, sf):
    """D12, D14"""
    x = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("ids"))
    known = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit(1).cast("long"))).otherwise(F.array(*[F.lit(k).cast("long") for k in (0, 2, 9)]))
    return x.select("conv_id", F.array_join(provenance.clean_sources(F.col("ids"), known).cast("array<string>"), ",").alias("sources"))


@query("""WITH x AS (SELECT doc_id, '===== PAGE 1 =====' || chr(10) || left(text, 150) || chr(10) || '===== PAGE 2 =====' || chr(10) || text AS text, CASE WHEN lang = 'en' AND length(text) > 400 THEN upper(text[160:190]) ELSE 'zzqq' END AS ev FROM documents WHERE text IS NOT NULL),
y AS (SELECT *, strpos(lower(text), lower(trim(ev))) AS pos, text[1:strpos(lower(text), lower(trim(ev)))-1] AS before FROM x)
SELECT doc_id, CASE WHEN pos > 0 THEN 'exact_text' ELSE 'not_located' END AS match, CASE WHEN pos > 0 THEN length(before) - length(replace(before, chr(10), '')) + 1 END AS line, CASE WHEN pos > 0 THEN regexp_extract_all(before, '===== PAGE ([0-9]+) =====', 1)[-1]::INT END AS page FROM y""")
def evidence_locator(t, spark, sf):
    """D15, F5"""
    d = t("documents").where("text is not null")
    text = F.concat(F.lit("===== PAGE 1 =====\n"), F.substring("text", 1, 150), F.lit("\n===== PAGE 2 =====\n"), F.col("text"))
    ev = F.when((F.col("lang") == "en") & (F.length("text") > 400), upper_each(F.substring("text", 160, 31))).otherwise("zzqq")
    return d.select("doc_id", provenance.locate(text, ev).alias("l")).select("doc_id", "l.match", F.col("l.line").cast("long").alias("line"), "l.page")


@query("""SELECT * FROM (SELECT 'announced' AS kind, o_orderdate AS at, o_orderkey AS ref FROM orders UNION ALL SELECT 'shipped', l_shipdate, l_orderkey FROM lineitem
UNION ALL SELECT 'event', ts, event_id FROM events UNION ALL SELECT 'label', NULL, doc_id FROM labels)""")
def process_timeline(t, spark, sf):
    """G8, H8"""
    return provenance.timeline([
        t("orders").select(F.lit("announced").alias("kind"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("ref")),
        t("lineitem").select(F.lit("shipped").alias("kind"), F.col("l_shipdate").alias("at"), F.col("l_orderkey").alias("ref")),
        t("events").select(F.lit("event").alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("ref")),
        t("labels").select(F.lit("label").alias("kind"), F.lit(None).cast("timestamp_ntz").alias("at"), F.col("doc_id").alias("ref")),
    ])


@query("""SELECT event_type AS stage, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total_s, sum(value::DECIMAL(18,4))::DOUBLE / count(*) AS avg_s, max(value::DECIMAL(18,4))::DOUBLE AS max_s FROM events GROUP BY 1""")
def stage_timings(t, spark, sf):
    """E9"""
    return telemetry.stage_timings(t("events").withColumnRenamed("event_type", "stage"), "stage", "value")


EWMA_SQL = """WITH RECURSIVE r AS (SELECT user_id, greatest(value, 0) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), f(user_id, rn, a) AS (
SELECT user_id, rn, v::DOUBLE FROM r WHERE rn = 1 UNION ALL SELECT r.user_id, r.rn, CASE WHEN f.a <= 0 THEN r.v ELSE 0.22::DOUBLE * r.v + (1 - 0.22::DOUBLE) * f.a END FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1)
SELECT user_id, round(arg_max(a, rn), 6) AS ewma, max(rn) AS n FROM f GROUP BY 1"""


@query(EWMA_SQL)
def provider_ewma(t, spark, sf):
    """E11"""
    return telemetry.ewma(t("events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", F.round("ewma", 6).alias("ewma"), "n")


@query("""WITH m AS (SELECT user_id, ts AS t, 1 AS d FROM events UNION ALL SELECT user_id, ts + INTERVAL 12 HOUR, -1 FROM events), s AS (SELECT user_id, t, sum(d) AS d FROM m GROUP BY ALL),
r AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM s) SELECT user_id, max(a)::BIGINT AS peak FROM r GROUP BY 1""")
def peak_active(t, spark, sf):
    """E12"""
    spans = t("events").select("user_id", F.col("ts").alias("s"), F.expr("ts + interval 12 hours").alias("e"))
    return telemetry.peak_active(spans, ["user_id"], "s", "e")


@query("""WITH RECURSIVE o AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'throttle' WHEN event_id % 11 = 0 THEN 'transient' WHEN event_id % 13 = 0 THEN 'other' ELSE 'ok' END AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f(user_id, rn, cap, streak, th, tr, ra) AS (SELECT DISTINCT user_id, 0::BIGINT, 4, 0, 0, 0, 0 FROM events UNION ALL
 SELECT o.user_id, o.rn, CASE WHEN k = 'ok' AND cap < 4 AND streak + 1 >= 2 * cap THEN cap + 1 WHEN k = 'throttle' THEN greatest(1, cap // 2) WHEN k = 'transient' THEN greatest(1, cap - 1) ELSE cap END,
 CASE WHEN k = 'ok' AND NOT (cap < 4 AND streak + 1 >= 2 * cap) THEN streak + 1 ELSE 0 END, th + (k = 'throttle')::INT, tr + (k = 'transient')::INT, ra + (k = 'ok' AND cap < 4 AND streak + 1 >= 2 * cap)::INT
 FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
SELECT user_id, arg_max(cap, rn) AS final_limit, arg_max(streak, rn) AS streak, max(th) AS throttles, max(tr) AS transients, max(ra) AS ramps FROM f GROUP BY 1""")
def gate_replay(t, spark, sf):
    """2.K: the adaptive provider gate over an outcome history"""
    kind = F.when(F.col("event_type") == "error", "throttle").when(F.col("event_id") % 11 == 0, "transient").when(F.col("event_id") % 13 == 0, "other").otherwise("ok")
    return telemetry.gate_replay(t("events").withColumn("k", kind), ["user_id"], ["ts", "event_id"], "k", most=4, per_step=2)


@query("""SELECT event_type, count(*) AS submitted, count(*) FILTER (WHERE event_id % 10 <> 0) AS completed, count(*) FILTER (WHERE event_id % 10 = 0) AS failed, sum(value::DECIMAL(18,4))::DOUBLE AS wait_s, max(value) AS longest_wait_s FROM events GROUP BY 1""")
def queue_metrics(t, spark, sf):
    """E12"""
    return telemetry.queue_metrics(t("events").withColumn("bad", F.col("event_id") % 10 == 0), ["event_type"], "value", "bad")


@query("""WITH r AS (SELECT s_suppkey AS run, s_suppkey % 13 AS processed, s_nationkey * 10.0 AS elapsed, s_suppkey % 8 + 1 AS llm_max, s_suppkey % 9 AS llm_peak, s_suppkey % 4 + 1 AS extract_workers, s_suppkey % 5 AS extract_peak, 8 AS inflight_max, s_nationkey % 9 AS inflight_peak,
 s_suppkey % 3 AS waited, 10 AS requests, CASE WHEN s_suppkey % 6 = 0 THEN 1 ELSE 0 END AS throttles, CASE WHEN s_suppkey % 10 = 1 THEN 2 ELSE 8 END AS limit_now, 8 AS limit_max FROM supplier),
x AS (SELECT *, CASE WHEN elapsed > 0 THEN processed / elapsed * 60.0 ELSE 0.0 END AS throughput, least(1.0, llm_peak / greatest(1, llm_max)) AS lr, least(1.0, extract_peak / greatest(1, extract_workers)) AS er, least(1.0, inflight_peak / greatest(1, inflight_max)) AS br, least(1.0, waited / greatest(1, requests)) AS wr, throttles > 0 OR limit_now < limit_max AS pressed FROM r),
b AS (SELECT *, CASE WHEN pressed THEN 'provider' WHEN wr >= 0.25 AND lr >= 0.75 THEN 'provider' WHEN br >= 0.85 AND er >= 0.75 THEN 'extraction' WHEN lr >= 0.95 AND wr < 0.1 AND llm_max < 8 THEN 'llm-capacity' WHEN lr < 0.5 AND br < 0.5 THEN 'preparation-or-source' ELSE 'balanced' END AS bottleneck FROM x)
SELECT run, throughput, bottleneck, CASE WHEN bottleneck IN ('provider', 'extraction') THEN 'high' WHEN bottleneck = 'preparation-or-source' AND processed < 8 THEN 'low' ELSE 'medium' END AS confidence,
CASE WHEN pressed THEN greatest(1, least(llm_max, limit_now)) WHEN bottleneck = 'llm-capacity' THEN llm_max + 1 ELSE llm_max END AS llm_slots, CASE WHEN bottleneck = 'extraction' AND extract_workers < 8 THEN extract_workers + 1 ELSE extract_workers END AS workers FROM b""")
def advisor_report(t, spark, sf):
    """E10"""
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    runs = t("supplier").select(
        s.alias("run"), (s % 13).alias("processed"), (n * F.lit(10.0)).alias("elapsed"), (s % 8 + 1).alias("llm_max"), (s % 9).alias("llm_peak"), (s % 4 + 1).alias("extract_workers"), (s % 5).alias("extract_peak"),
        F.lit(8).alias("inflight_max"), (n % 9).alias("inflight_peak"), (s % 3).alias("waited"), F.lit(10).alias("requests"), F.when(s % 6 == 0, 1).otherwise(0).alias("throttles"), F.when(s % 10 == 1, 2).otherwise(8).alias("limit_now"), F.lit(8).alias("limit_max"),
    )
    return telemetry.advise(runs).select("run", "throughput", "bottleneck", "confidence", "llm_slots", "workers")


@query("""WITH l AS (SELECT conv_id AS run, arg_max(role, turn) AS k, max(turn) AS last_event, count(*) AS events FROM conversations GROUP BY 1) SELECT run, CASE WHEN k = 'assistant' THEN 'completed' ELSE 'interrupted' END AS state, last_event, events FROM l""")
def run_states(t, spark, sf):
    """A22, A23, E19"""
    c = t("conversations").select(F.col("conv_id").alias("run"), "turn", F.when(F.col("role") == "assistant", "completed").otherwise("running").alias("kind"))
    return telemetry.run_state(c, "run", "turn", "kind")


@query("""WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations) SELECT conv_id, turn, role, total FROM r WHERE back <= 3""")
def event_log_tail(t, spark, sf):
    """A21, F6, G11"""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id")
    rows = t("conversations").select("conv_id", "turn", "role").withColumns({"_back": F.row_number().over(w.orderBy(F.desc("turn"))), "total": F.count(F.lit(1)).over(w)})
    return rows.where("_back <= 3").drop("_back")


@query("""WITH a AS (SELECT l_orderkey AS g, 'u' || l_linenumber AS url, CASE WHEN l_linenumber = 1 THEN '' ELSE 'F' || l_linenumber || '.PDF' END AS filename, CASE WHEN l_linenumber = 2 THEN '' ELSE l_returnflag END AS kind FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1)
SELECT count(*) AS n, count(DISTINCT g) AS groups FROM a""")
def distinct_sources(t, spark, sf):
    """Sources that occur once in their announcement"""
    a = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("c")).where("c = 1")
    return a.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("groups"))


class SteppedPages:
    """A deterministic page provider: 1,000 records, some without an id, some ids twice."""

    total = 1000

    def page(self, offset: int, size: int) -> tuple[list[dict], int]:
        rows = range(offset, min(offset + size, self.total))
        return [{"id2": "" if i % 50 == 49 else f"A{i % 900}", "payload": f"record {i}"} for i in rows], self.total


@query("""WITH r AS (SELECT i, CASE WHEN i % 50 = 49 THEN '' ELSE 'A' || (i % 900) END AS id2 FROM range(1000) t(i)), k AS (SELECT id2, min(i) AS i FROM r WHERE id2 <> '' GROUP BY 1) SELECT id2, 'record ' || i AS payload, i // 64 AS page, i % 64 AS place FROM k""")
def paged_source_scan(t, spark, sf):
    """A1-A5"""
    raw = paged.scan(spark, SteppedPages(), 64, name="stepped_pages")
    return paged.first_wins(raw).select("id2", "payload", F.col("page").cast("long").alias("page"), F.col("place").cast("long").alias("place"))


@query("SELECT 1000 AS reported, 1000 AS collected, 882 AS distinct_ids, 16 AS pages, true AS complete")
def paged_completeness(t, spark, sf):
    """A1, A2: the report that proves the read"""
    return paged.completeness(paged.scan(spark, SteppedPages(), 64, name="stepped_pages"), 64)


@query()
def html_text(t, spark, sf):
    """A14"""
    return t("pages").select("page_id", extract.html_text(F.col("html")).alias("text")).select("page_id", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""WITH p AS (SELECT doc_id AS d, text[1:300] AS a, text[301:340] AS b, text[341:600] AS o FROM documents WHERE length(text) > 700 AND NOT regexp_matches(text, '[ \\t]{2,}|^\\s|\\n{4,}|\\n ')), q AS (SELECT d, '===== PAGE 1 =====' || chr(10) || a || chr(10) || chr(10) || '===== PAGE 2 =====' || chr(10) || o AS t FROM p)
SELECT d AS doc_id, 'pdf-native+ocr' AS method, length(regexp_replace(t, '\\s+$', '')) AS n FROM q""")
def pdf_pages(t, spark, sf):
    """A10: page choice and assembly"""
    d = t("documents").where(F.length("text") > 700).where(~F.col("text").rlike(r"[ \t]{2,}|^\s|\n{4,}|\n "))
    one = d.select("doc_id", F.lit(1).alias("page_no"), F.substring("text", 1, 300).alias("native_text"), F.lit("short").alias("ocr_text"))
    two = d.select("doc_id", F.lit(2).alias("page_no"), F.substring("text", 301, 40).alias("native_text"), F.substring("text", 341, 260).alias("ocr_text"))
    return extract.assemble_pages(one.unionByName(two)).select("doc_id", "method", F.length("text").cast("long").alias("n"))


@query("""WITH r AS (SELECT l_orderkey AS doc, l_linenumber AS row, l_suppkey, l_partkey, (l_quantity)::INT AS cells FROM lineitem), s AS (SELECT *, sum(cells) OVER (PARTITION BY doc ORDER BY row, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS run FROM r) SELECT doc, count(*) AS rows, sum(cells)::BIGINT AS cells FROM s WHERE run <= 100 GROUP BY 1""")
def cell_budget(t, spark, sf):
    """F7, A11"""
    r = t("lineitem").select(F.col("l_orderkey").alias("doc"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("cells"))
    kept = extract.within_budget(r, "doc", ["l_linenumber", "l_partkey", "l_suppkey"], "cells", 100)
    return kept.groupBy("doc").agg(F.count(F.lit(1)).alias("rows"), F.sum("cells").alias("cells"))


def _stream(t, spark, sf):
    return streams.read_stream(spark, f"{sf}/event[s].parquet", t("events")).withColumn("ts", F.col("ts").cast("timestamp"))


def _room(spark) -> str:
    from tidemark.lineage import folder

    return f"{folder(spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def stream_dedup(t, spark, sf):
    """2.L: late-tolerant deduplication by id"""
    out = streams.run_to_table(streams.unique_events(_stream(t, spark, sf), "ts", "event_id").select("event_id", "event_type"), _room(spark))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query("""WITH w AS (SELECT date_trunc('day', ts)::TIMESTAMP AS start_at, count(*) AS n FROM events GROUP BY 1), m AS (SELECT max(ts) - INTERVAL 1 DAY AS wm FROM events) SELECT start_at, start_at + INTERVAL 1 DAY AS end_at, n FROM w, m WHERE start_at + INTERVAL 1 DAY <= date_trunc('millisecond', wm)""")
def stream_windows(t, spark, sf):
    """2.L: closed event-time windows"""
    out = streams.run_to_table(streams.tumbling_counts(_stream(t, spark, sf), "ts", "1 day"), _room(spark))
    return out.select(F.col("start_at").cast("timestamp_ntz").alias("start_at"), F.col("end_at").cast("timestamp_ntz").alias("end_at"), "n")


@query(EWMA_SQL)
def stream_ewma(t, spark, sf):
    """2.L, E11: the same fold as state"""
    out = streams.run_to_table(streams.ewma_stream(_stream(t, spark, sf).select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value"), _room(spark), mode="update")
    last = out.groupBy("user_id").agg(F.max_by("ewma", "n").alias("ewma"), F.max("n").alias("n"))
    return last.select("user_id", F.round("ewma", 6).alias("ewma"), "n")


@query("SELECT c.conv_id, c.turn, c.role FROM conversations c WHERE c.turn > CASE WHEN c.conv_id % 2 = 0 THEN 1 ELSE -1 END")
def stream_event_cursor(t, spark, sf):
    """2.L: cursor reads"""
    rows = t("conversations").select("conv_id", "turn", "role")
    cursors = rows.where("conv_id % 2 = 0").select("conv_id", F.lit(1).alias("cursor")).distinct()
    return streams.after_cursor(rows, "conv_id", "turn", cursors).select("conv_id", "turn", "role")


@query("SELECT o_orderkey AS id2, '%' || o_orderkey || '%' AS claim FROM orders")
def claim_texts(t, spark, sf):
    """I9"""
    a = announcements(t)
    text = F.concat(F.lit(" %"), F.col("id2").cast("string"), F.lit("% "))
    none = F.lit(None).cast("string")
    return a.select("id2", provenance.claim_text(text, none, none, none, none).alias("claim"))
