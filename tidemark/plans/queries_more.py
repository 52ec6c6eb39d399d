"""Orders, dispatch, caches, overrides and failure classes as queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import digest, ordering, triage, validate
from tidemark.operators.attachments import merge_candidates
from tidemark.plans.registry import ATTACHMENTS_SQL, WINDOWS_SQL, announcements, attachments, query, windows


@query(f"""WITH {ATTACHMENTS_SQL}, c AS (SELECT announcement_id, is_attachment, filename, count(*) AS n FROM att GROUP BY ALL)
SELECT announcement_id, filename, n, row_number() OVER (PARTITION BY announcement_id ORDER BY is_attachment, filename) AS position FROM c""")
def attachment_order(t, spark, sf):
    """G1"""
    a = attachments(t).groupBy("announcement_id", "is_attachment", "filename").agg(F.count(F.lit(1)).alias("n"))
    return ordering.placed(a, ["announcement_id"], ["is_attachment", "filename"]).select("announcement_id", "filename", "n", "position")


@query("SELECT o_custkey AS ticker, o_orderkey AS id2, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders")
def announcement_order(t, spark, sf):
    """By time inside a company"""
    return ordering.placed(announcements(t), ["ticker"], ["announced_at", "id2"]).select("ticker", "id2", "position")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d %H:%M:%S') DESC, event_id) AS position FROM events")
def record_order(t, spark, sf):
    """Newest first, by the time as text"""
    e = t("events").withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return ordering.placed(e, ["user_id"], [F.desc("at"), "event_id"]).select("user_id", "event_id", "position")


@query(f"WITH {WINDOWS_SQL} SELECT ticker, start_at, end_at, row_number() OVER (PARTITION BY ticker ORDER BY start_at, end_at) AS position FROM w")
def export_order(t, spark, sf):
    """G10"""
    return ordering.placed(windows(t), ["ticker"], ["start_at", "end_at"]).select("ticker", "start_at", "end_at", "position")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def event_sequence(t, spark, sf):
    """F6"""
    return ordering.placed(t("events"), ["user_id"], ["ts", "event_id"], "seq").select("user_id", "event_id", "seq")


@query("""WITH j AS (SELECT l_suppkey AS ticker, ['announcement','chunk','company'][l_linenumber % 3 + 1] AS stage, l_orderkey AS job, l_linenumber AS part, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker, stage ORDER BY job, part) - 1 AS k FROM j)
SELECT ticker, stage, job, part, k // (CASE stage WHEN 'announcement' THEN 3 WHEN 'chunk' THEN 2 ELSE 1 END) AS round FROM r""")
def fair_dispatch(t, spark, sf):
    """F11"""
    stage = F.element_at(F.array(F.lit("announcement"), F.lit("chunk"), F.lit("company")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    j = t("lineitem").select(F.col("l_suppkey").alias("ticker"), stage.alias("stage"), F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("part")).distinct()
    return ordering.fair_rounds(j, "ticker", "stage", ["job", "part"]).select("ticker", "stage", "job", "part", "round")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def ttl_cache(t, spark, sf):
    """The time now is that of the last event"""
    e = t("events")
    now = e.agg(F.max(F.col("ts").cast("timestamp")).alias("_now"))
    return ordering.fresh(e.join(F.broadcast(now)), "ts", 24, F.col("_now")).select("event_id")  # one row


@query("""SELECT user_id, greatest(0, epoch((SELECT date_trunc('second', max(ts)) FROM events WHERE event_id % 2 = 0))::BIGINT - epoch(date_trunc('second', max(ts)))::BIGINT) AS stale_s FROM events GROUP BY 1""")
def run_staleness(t, spark, sf):
    """The time now is that of the last even event, so that some runs are ahead of it"""
    e = t("events")
    now = e.where("event_id % 2 = 0").agg(F.max(F.col("ts").cast("timestamp")).alias("_now"))
    last = e.groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last"))
    return last.join(F.broadcast(now)).select("user_id", ordering.staleness(F.col("last"), F.col("_now")).alias("stale_s"))  # one row


@query("""WITH s AS (SELECT o_custkey AS k, date_trunc('day', o_orderdate)::TIMESTAMP + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 86399 SECOND ELSE INTERVAL 86340 SECOND END AS end_at, max(o_totalprice) AS value FROM orders GROUP BY ALL),
q AS (SELECT DISTINCT o_custkey AS k, date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 86340 SECOND AS end_at FROM orders)
SELECT q.k, q.end_at, coalesce(x.value, y.value) AS value FROM q LEFT JOIN s x ON x.k = q.k AND x.end_at = q.end_at LEFT JOIN s y ON y.k = q.k AND y.end_at = q.end_at + INTERVAL 59 SECOND""")
def minute_fallback(t, spark, sf):
    """U15"""
    o = t("orders")
    day = F.date_trunc("day", "o_orderdate").cast("timestamp_ntz")
    end = F.when(F.col("o_orderkey") % 2 == 0, day + F.expr("interval 86399 seconds")).otherwise(day + F.expr("interval 86340 seconds"))
    saved = o.select(F.col("o_custkey").alias("k"), end.alias("end_at"), "o_totalprice").groupBy("k", "end_at").agg(F.max("o_totalprice").alias("value"))
    wanted = o.select(F.col("o_custkey").alias("k"), (day + F.expr("interval 86340 seconds")).alias("end_at")).distinct()
    return ordering.window_or_full_day(wanted, saved, ["k"])


@query("""WITH a AS (SELECT announcement_id, doc_id FROM (SELECT doc_id // 3 AS announcement_id, doc_id, text FROM documents)),
d AS (SELECT doc_id // 3 AS announcement_id, text IS NOT NULL AND row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS suppressed FROM documents)
SELECT DISTINCT announcement_id FROM a WHERE announcement_id NOT IN (SELECT announcement_id FROM d WHERE suppressed)""")
def summaries_left(t, spark, sf):
    """A suppressed copy makes its announcement's cached summary void"""
    d = t("documents").select((F.floor(F.col("doc_id") / 3)).cast("long").alias("announcement_id"), "doc_id", "text")
    first = d.where("text is not null").groupBy("text").agg(F.min("doc_id").alias("_first"))
    marked = d.join(first, "text", "left").withColumn("suppressed", F.coalesce(F.col("doc_id") != F.col("_first"), F.lit(False)))
    return ordering.without_suppressed(d.select("announcement_id").distinct(), marked, "announcement_id")


@query("""SELECT o_orderkey AS id2, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'full' WHEN o_orderstatus = 'F' THEN 'routine_direct' ELSE 'full' END AS mode,
 CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'extraction-failure,late' ELSE 'late' END AS signals FROM orders""")
def extraction_override(t, spark, sf):
    """C15"""
    d = t("orders").select(F.col("o_orderkey").alias("id2"), F.when(F.col("o_orderstatus") == "F", "routine_direct").otherwise("full").alias("mode"), F.array(F.lit("late")).alias("signals"))
    return triage.failure_override(d, F.col("id2") % 3 == 0).select("id2", "mode", F.array_join("signals", ",").alias("signals"))


@query("SELECT doc_id, coalesce(trim(lang) <> '', false) OR coalesce(len(string_split(source, 's')) > 2, false) AS usable FROM documents")
def legacy_usable(t, spark, sf):
    """C17"""
    d = t("documents")
    return d.select("doc_id", validate.usable_legacy([F.col("lang")], [F.slice(F.split("source", "s"), 3, 9)]).alias("usable"))


@query("SELECT o_custkey AS k, bool_and(o_orderstatus IN ('F', 'P')) AS isolated FROM (SELECT o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'P' ELSE o_orderstatus END AS o_orderstatus FROM orders) GROUP BY 1")
def company_isolation(t, spark, sf):
    """A blank ticker is no foreign one"""
    o = t("orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.lower("o_orderstatus")).alias("ticker"))
    return o.groupBy("k").agg(validate.isolated(o, "f").alias("isolated"))


_LINE = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(f"""WITH RECURSIVE a AS (SELECT l_orderkey AS g, 0 AS source, {_LINE}, CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE 'u' || (l_suppkey % 3) END AS url,
  CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 'F' || (l_partkey % 4) || '.PDF' END AS filename, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_returnflag END AS kind FROM lineitem WHERE l_linenumber <> 5),
b AS (SELECT l_orderkey AS g, 1 AS source, {_LINE}, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'u' || (l_partkey % 6) END AS url, 'f' || (l_suppkey % 5) || '.pdf' AS filename, 'S' || l_linestatus AS kind FROM lineitem WHERE l_linenumber <> 3),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY source, {_LINE}) AS i FROM (SELECT * FROM a UNION ALL SELECT * FROM b)),
fold(g, i, urls, names, places) USING KEY (g) AS (
  SELECT DISTINCT g, 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::BIGINT[] FROM r
  UNION
  SELECT g, i, CASE WHEN hit IS NULL THEN list_append(urls, url) ELSE urls END, CASE WHEN hit IS NULL THEN list_append(names, name) ELSE names END, list_append(places, coalesce(hit, len(urls) + 1)::BIGINT)
  FROM (SELECT f.*, r.i AS next, nullif(r.url, '') AS url, nullif(lower(r.filename), '') AS name, coalesce(CASE WHEN r.url <> '' THEN list_position(f.urls, r.url) END, CASE WHEN r.filename <> '' THEN list_position(f.names, lower(r.filename)) END) AS hit
        FROM fold f JOIN r ON r.g = f.g AND r.i = f.i + 1) x(g, old, urls, names, places, i, url, name, hit)),
told AS (SELECT g, unnest(places) AS place, generate_subscripts(places, 1) AS i FROM fold)
SELECT r.g AS group_id, coalesce(arg_min(url, r.i) FILTER (url <> ''), CASE WHEN bool_or(url IS NOT NULL AND r.i = first_i) THEN '' END) AS url, arg_min(filename, r.i) FILTER (filename <> '') AS filename,
  coalesce(arg_min(kind, r.i) FILTER (kind <> ''), '') AS kind
FROM (SELECT t.*, min(t.i) OVER (PARTITION BY t.g, t.place) AS first_i FROM told t) t JOIN r ON r.g = t.g AND r.i = t.i GROUP BY r.g, t.place""")
def merged_attachments(t, spark, sf):
    """Urls and names repeat inside and across announcements, in either source"""
    rows = t("lineitem")
    group, order = F.col("l_orderkey").alias("group_id"), [c.strip() for c in _LINE.split(",")]
    mark = lambda text, column, n, end="": F.concat(F.lit(text), (F.col(column) % n).cast("string"), F.lit(end))
    a = rows.where("l_linenumber <> 5").select(
        group, *order, F.when(F.col("l_suppkey") % 4 == 0, "").otherwise(mark("u", "l_suppkey", 3)).alias("url"), F.when(F.col("l_partkey") % 5 != 0, mark("F", "l_partkey", 4, ".PDF")).alias("filename"),
        F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.col("l_returnflag")).alias("kind"),
    )
    b = rows.where("l_linenumber <> 3").select(
        group, *order, F.when(F.col("l_partkey") % 3 != 0, mark("u", "l_partkey", 6)).alias("url"), mark("f", "l_suppkey", 5, ".pdf").alias("filename"), F.concat(F.lit("S"), "l_linestatus").alias("kind"),
    )
    return merge_candidates(a, b, ["url", "filename", "kind"], order)


@query("""SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.0f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.1f GB', n / 1073741824) END AS size
FROM (SELECT doc_id, (length(text) * 1000 * (doc_id % 3) + 1)::DOUBLE AS n FROM documents WHERE text IS NOT NULL)""")
def byte_sizes(t, spark, sf):
    """I22; null text has no size"""
    d = t("documents").where("text is not null").withColumn("n", F.length("text").cast("long") * 1000 * (F.col("doc_id") % 3) + 1)
    return d.select("doc_id", tx.byte_size(F.col("n")).alias("size"))


ERRORS = ["HTTP 429 too many requests", "OpenRouter request failed: 503", "read timed out", "Temporary failure in name resolution", "bad value", "ConnectError: no route", "request throttled", "502 from gateway", "timeout of model"]
ERRORS_SQL = ", ".join(f"'{e}'" for e in ERRORS)


@query(f"""WITH m AS (SELECT event_id, lower(([{ERRORS_SQL}])[event_id % 9 + 1]) AS e FROM events)
SELECT event_id, regexp_matches(e, 'openrouter request failed|connecterror|connection|timed out|timeout|temporary failure|network|429|502|503|504') AS network,
 CASE WHEN event_id % 4 = 0 THEN 'malformed_json' WHEN regexp_matches(e, '429|rate limit|throttl') THEN 'rate_limited' WHEN regexp_matches(e, 'timeout|timed out') THEN 'timeout'
 WHEN contains(e, '5') AND contains(e, 'openrouter request failed') THEN 'provider_error' ELSE 'structured_output_error' END AS reason FROM m""")
def failure_classes(t, spark, sf):
    """C20: network faults and retry reasons"""
    message = F.element_at(F.array(*[F.lit(e) for e in ERRORS]), (F.col("event_id") % 9 + 1).cast("int"))
    return t("events").select("event_id", digest.failed_on_network(message).alias("network"), digest.retry_reason(message, F.col("event_id") % 4 == 0).alias("reason"))


@query("""SELECT o_custkey AS k, sum(coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderkey % 10 END, 0), nullif(o_orderkey % 4, 0), 0))::BIGINT AS reported, count(*) AS collected FROM orders GROUP BY 1""")
def run_totals(t, spark, sf):
    """The fallback chain of reported totals"""
    key = F.col("o_orderkey")
    first = F.when(key % 3 == 0, F.lit(0).cast("long")).when(key % 3 == 2, key % 10)
    return t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum(ordering.reported_total(first, key % 4)).alias("reported"), F.count(F.lit(1)).alias("collected"))


@query("SELECT conv_id, sum(length(text))::BIGINT AS characters, count(*) AS messages FROM conversations GROUP BY 1")
def message_characters(t, spark, sf):
    """E16"""
    return t("conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("characters"), F.count(F.lit(1)).alias("messages"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(t, spark, sf):
    """H7: distinct values in order of their first place"""
    first = t("conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("at"))
    return first.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "role"))), lambda x: x["role"]), ",").alias("roles"))


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n, o_orderstatus AS s FROM orders)
SELECT a.k, a.id AS query_range, b.id AS gap FROM o a JOIN o b ON a.k = b.k AND a.n = b.n AND a.s = 'O' AND b.s = 'F'""")
def paired_ranges(t, spark, sf):
    """Paired by place"""
    lists = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey")))).alias("a"), F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))).alias("b")
    )
    return lists.select("k", F.explode(ordering.pair_up(F.col("a"), F.col("b"), "query_range", "gap")).alias("p")).select("k", "p.*")


PLANTED = ["", " perubahan pengendali", " direksi telah membeli", " pengalihan saham", " kenaikan kepemilikan", " penurunan jumlah kepemilikan", " free float kurang dari", " saham treasuri dijual", ""]
PLANTED_SQL = ", ".join(f"'{p}'" for p in PLANTED)
RISKS_SQL = ", ".join(f"CASE WHEN regexp_matches(a, '{p}') THEN '{name}' END" for name, p in triage.RISKS.items())


@query(f"""WITH d AS (SELECT doc_id // 2 AS g, doc_id, text || ([{PLANTED_SQL}])[doc_id % 9 + 1] AS text, CASE WHEN doc_id // 2 % 4 = 0 THEN 'other' ELSE 'Laporan Bulanan Registrasi Pemegang Efek' END AS title FROM documents),
f AS (SELECT g, max(title) AS title, coalesce(sum(length(text)), 0)::BIGINT AS total_characters, count(text) AS document_count, min(length(regexp_replace(text, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))) AS least, string_agg(text, chr(10) ORDER BY doc_id) AS a FROM d GROUP BY 1),
s AS (SELECT *, CASE WHEN title = 'other' THEN 'not-routine' WHEN document_count = 0 THEN 'no-evidence' WHEN total_characters > 70000 THEN 'large-evidence' WHEN least < 120 THEN 'sparse-evidence' END AS odd, list_sort(list_filter([{RISKS_SQL}], lambda x: x IS NOT NULL)) AS found FROM f)
SELECT g, CASE WHEN odd IS NULL AND len(found) = 0 THEN 'routine_direct' ELSE 'full' END AS mode, CASE WHEN odd IS NOT NULL THEN odd WHEN len(found) > 0 THEN 'material-change' ELSE 'clean' END AS reason,
 CASE WHEN odd = 'not-routine' THEN '' WHEN odd IS NOT NULL THEN odd ELSE array_to_string(found, ',') END AS signals, total_characters, document_count FROM s""")
def routine_triage(t, spark, sf):
    """The seven risk rules over every document, with a phrase of each planted"""
    planted = F.element_at(F.array(*[F.lit(p) for p in PLANTED]), (F.col("doc_id") % 9 + 1).cast("int"))
    g = F.floor(F.col("doc_id") / 2).cast("long")
    title = F.when(g % 4 == 0, "other").otherwise("Laporan Bulanan Registrasi Pemegang Efek")
    d = t("documents").select(g.alias("g"), F.col("doc_id").alias("position"), F.concat("text", planted).alias("text"), title.alias("title"))
    out = triage.triage(d, "g", ownership="(?i)nothing like this")
    return out.select("g", "mode", "reason", F.array_join("signals", ",").alias("signals"), "total_characters", "document_count")


DELTAS = ["\nkepemilikan saham 5,10% menjadi 5.25 %", "\npemegang 7.00% dan 7,05%", "\nkepemilikan 3% saja", "", "\nlain 1% 9%", "\nDireksi 1% lalu 2,5% dan 2%", "\n" + "kepemilikan " * 120 + "1% 9%"]
DELTAS_SQL = ", ".join("'" + d.replace("\n", "' || chr(10) || '") + "'" for d in DELTAS)
_LINES_SQL = r"regexp_split_to_array(a, '\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]')"
_SQUEEZE_SQL = r"trim(regexp_replace(q, '[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+', ' ', 'g'))"


@query(f"""WITH d AS (SELECT doc_id // 2 AS g, doc_id, text || ([{PLANTED_SQL}])[doc_id % 9 + 1] || ([{DELTAS_SQL}])[doc_id // 3 % 7 + 1] AS text, CASE WHEN doc_id // 2 % 4 = 0 THEN 'other' ELSE 'Laporan Bulanan Registrasi Pemegang Efek' END AS title FROM documents),
f AS (SELECT g, max(title) AS title, coalesce(sum(length(text)), 0)::BIGINT AS total_characters, count(text) AS document_count, min(length(regexp_replace(text, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))) AS least, string_agg(text, chr(10) ORDER BY doc_id) AS a FROM d GROUP BY 1),
o AS (SELECT *, CASE WHEN title = 'other' THEN 'not-routine' WHEN document_count = 0 THEN 'no-evidence' WHEN total_characters > 70000 THEN 'large-evidence' WHEN least < 120 THEN 'sparse-evidence' END AS odd FROM f),
l AS (SELECT g, i, list_transform(regexp_extract_all(q, '(?:^|[^0-9])([0-9]{{1,3}}(?:[.,][0-9]{{1,4}})?)\\s*%', 1), lambda v: replace(v, ',', '.')::DOUBLE) AS p
  FROM (SELECT g, i, {_SQUEEZE_SQL} AS q FROM (SELECT g, unnest({_LINES_SQL}) AS q, generate_subscripts({_LINES_SQL}, 1) AS i FROM o WHERE odd IS NULL)) WHERE length(q) <= 1200 AND regexp_matches(q, '(?i)pemegang|kepemilikan|pengendali|direksi|direktur|komisaris|free\\s*float|treasuri')),
w AS (SELECT g, arg_min(list_min(p), i) AS low, arg_min(list_max(p), i) AS high FROM l WHERE len(p) >= 2 AND list_max(p) - list_min(p) >= 0.1 GROUP BY 1),
s AS (SELECT o.*, low, high, list_sort(list_filter([{RISKS_SQL}, CASE WHEN low IS NOT NULL THEN 'ownership-percentage-delta' END], lambda x: x IS NOT NULL)) AS found FROM o LEFT JOIN w ON w.g = o.g)
SELECT g, CASE WHEN odd IS NULL AND len(found) = 0 THEN 'routine_direct' ELSE 'full' END AS mode, CASE WHEN odd IS NOT NULL THEN odd WHEN len(found) > 0 THEN 'material-change' ELSE 'clean' END AS reason,
 CASE WHEN odd = 'not-routine' THEN '' WHEN odd IS NOT NULL THEN odd ELSE array_to_string(found, ',') END AS signals, low, high FROM s""")
def routine_triage_delta(t, spark, sf):
    """The ladder with its last rung, the first line about ownership whose percentages differ, over every document"""
    pick = lambda texts, n: F.element_at(F.array(*[F.lit(x) for x in texts]), (n + 1).cast("int"))
    g = F.floor(F.col("doc_id") / 2).cast("long")
    title = F.when(g % 4 == 0, "other").otherwise("Laporan Bulanan Registrasi Pemegang Efek")
    text = F.concat("text", pick(PLANTED, F.col("doc_id") % 9), pick(DELTAS, F.floor(F.col("doc_id") / 3) % 7))
    d = t("documents").select(g.alias("g"), F.col("doc_id").alias("position"), text.alias("text"), title.alias("title"))
    out = triage.triage(d, "g")
    return out.select("g", "mode", "reason", F.array_join("signals", ",").alias("signals"), "detail.low", "detail.high")
