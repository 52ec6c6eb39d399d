"""Files written, read back and stored by content: exports, run logs with broken lines, a content-addressed store."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.lineage import folder
from tidemark.operators import exports
from tidemark.plans.registry import WINDOWS_SQL, announcements, query, windows
from tidemark.sources import files, run_logs
from tidemark.sources.content_store import ContentStore, scan_files


def _room(spark, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH {WINDOWS_SQL}, n AS (SELECT o_custkey AS ticker, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey::VARCHAR) AS line, o_orderkey AS id2, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END AS overview FROM orders),
l AS (SELECT ticker, arg_max(start_at, (updated_at, start_at, end_at)) AS start_at, arg_max(n, (updated_at, start_at, end_at)) AS n FROM w GROUP BY 1)
SELECT n.*, l.start_at AS latest_start, l.n AS latest_n FROM n JOIN l USING (ticker)""")
def company_export(t, spark, sf):
    """A folder a company, written all or none and read back"""
    room, o = _room(spark, "export"), announcements(t)
    summary = F.when(F.col("status") != "O", F.struct(F.col("title").alias("overview")))
    record = F.struct("id2", F.col("announced_at").cast("string").alias("announced_at"), "title", summary.alias("summary"))
    window = F.struct(F.col("start_at").cast("string").alias("start_at"), F.col("end_at").cast("string").alias("end_at"), F.struct("n").alias("summary"))
    written = files.write_named(exports.company_files(o, windows(t), "ticker", "announced_at", "id2", record, window, "updated_at", ["start_at", "end_at"]), room, ["place"])
    ticker = F.element_at(F.split("file", "/"), -2).cast("long").alias("ticker")
    lines = files.written_lines(written, room, r"[^/]+/announcements\.jsonl")
    line = F.row_number().over(Window.partitionBy("file").orderBy("place")).alias("line")
    got = lines.select(ticker, line, F.from_json("value", "id2 long, summary struct<overview:string>").alias("r")).select("ticker", "line", "r.id2", "r.summary.overview")
    latest = files.written_lines(written, room, r"[^/]+/latest_window_summary\.json").select(ticker, F.from_json("value", "start_at timestamp_ntz, summary struct<n:long>").alias("r"))
    return got.join(latest.select("ticker", F.col("r.start_at").alias("latest_start"), F.col("r.summary.n").alias("latest_n")), "ticker")


@query("""WITH r AS (SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY 1)
SELECT CASE WHEN user_id % 5 = 0 THEN 'folder-' || user_id ELSE 'run-' || user_id END AS run_id, CASE WHEN user_id % 3 = 0 THEN 'unknown' ELSE kind END AS status, CASE WHEN user_id % 2 = 0 THEN 'incremental' WHEN user_id % 11 = 0 THEN 'report' ELSE 'scrape' END AS mode,
 CASE WHEN user_id % 4 = 0 THEN 2 ELSE n END AS company_summaries, CASE WHEN user_id % 6 = 0 THEN 0 ELSE n END AS last_seq, 'events,state' AS artifacts, strftime(last, '%Y-%m-%d %H:%M:%S') AS finished_at FROM r WHERE user_id % 7 <> 0""")
def run_library(t, spark, sf):
    """State files, some broken, with every fallback of the library's columns"""
    room, u = _room(spark, "runs"), F.col("user_id")
    last = F.struct("ts", "event_id")
    r = t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.max_by("event_type", last).alias("kind"))
    text = lambda c: c.cast("string")
    state = F.struct(
        F.when(u % 5 != 0, F.concat(F.lit("run-"), text(u))).alias("run_id"), F.when(u % 3 == 0, "").otherwise(F.col("kind")).alias("status"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("finished_at"),
        F.struct(F.when(u % 2 == 0, "incremental").alias("mode")).alias("request"),
        F.struct(F.when(u % 11 == 0, "report").alias("mode"), F.when(u % 4 == 0, F.lit(0).cast("long")).otherwise(F.col("n")).alias("company_summaries")).alias("report"),
        F.struct(F.struct(F.lit(1).alias("x")).alias("AAAA"), F.lit("y").alias("BBBB")).alias("summaries"), F.when(u % 6 != 0, F.col("n")).alias("last_seq"),
        F.struct(F.lit("s").alias("state"), F.lit("e").alias("events")).alias("artifact_paths"),
    )
    line = F.when(u % 7 == 0, F.substring(F.to_json(state), 1, 25)).otherwise(F.to_json(state))
    files.write_named(r.select(F.concat(F.lit("folder-"), text(u), F.lit("/state.json")).alias("name"), line.alias("line"), F.lit(0).alias("place")), room, ["place"])
    found = run_logs.run_library(spark, room)
    return found.select("run_id", "status", "mode", "company_summaries", "last_seq", F.array_join("artifacts", ",").alias("artifacts"), "finished_at")


@query("""WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line, count(*) OVER (PARTITION BY user_id) AS total FROM events),
g AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS returned FROM n WHERE line > total - 20 AND line % 9 <> 4) SELECT 'run-' || user_id AS run_id, line, line AS seq, event_type AS stage, total, returned FROM g""")
def raw_log_tail(t, spark, sf):
    """The last twenty lines of each raw log, broken ones passed over, with what there is and what is told"""
    room = _room(spark, "logs")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq")
    n = t("events").select("user_id", "event_type", seq)
    whole = F.to_json(F.struct("seq", F.lit("event").alias("type"), F.col("event_type").alias("stage")))
    name = F.concat(F.lit("run-"), F.col("user_id").cast("string"), F.lit("/events.jsonl")).alias("name")
    files.write_named(n.select(name, F.when(F.col("seq") % 9 == 4, F.substring(whole, 1, 9)).otherwise(whole).alias("line"), "seq"), room, ["seq"])
    return run_logs.log_tails(spark, room, limit=20).select("run_id", "line", "seq", "stage", "total", "returned")


@query("""WITH f AS (SELECT 'page-' || page_id || '.html' AS name, coalesce(html, '') || chr(10) AS body FROM pages UNION ALL SELECT 'copy-' || page_id || '.html', coalesce(html, '') || chr(10) FROM pages WHERE page_id % 3 = 0),
k AS (SELECT *, sha256(body) AS sha256, octet_length(encode(body)) AS length FROM f), m AS (SELECT *, min(name) OVER (PARTITION BY sha256) AS first FROM k)
SELECT name, sha256, length, left(sha256, 2) || '/' || left(sha256, 12) || '_' || name AS path, CASE WHEN name = first THEN 'written' ELSE 'already-exists' END AS cache_status, 'already-exists' AS again, 0::BIGINT AS added, (SELECT count(DISTINCT sha256) FROM k) AS kept FROM m""")
def content_store(t, spark, sf):
    """Files by the hash of their bytes; a second write adds nothing"""
    room, p = _room(spark, "content"), t("pages")
    body = F.coalesce("html", F.lit(""))
    name = lambda kind: F.concat(F.lit(kind), F.col("page_id").cast("string"), F.lit(".html")).alias("name")
    pages = p.select(name("page-"), body.alias("line")).unionByName(p.where("page_id % 3 = 0").select(name("copy-"), body.alias("line")))
    files.write_named(pages.withColumn("place", F.lit(0)), f"{room}/raw", ["place"])
    store, found = ContentStore(spark, f"{room}/store"), scan_files(spark, f"{room}/raw", "*.html")
    first = store.add(found)
    before = store.read().count()
    second = store.add(found)
    after = store.read()
    out = first.join(second.select("name", F.col("cache_status").alias("again")), "name")
    return out.withColumns({"added": F.lit(after.count() - before).cast("long"), "kept": F.lit(after.select("sha256").distinct().count()).cast("long")})
