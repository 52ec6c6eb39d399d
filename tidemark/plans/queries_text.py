"""Text, selection, triage, near-duplicates, chunks and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import dedup, digest, library, selection, triage, validate
from tidemark.plans.registry import ATTACHMENTS_SQL, announcements, attachments, query

WS = r"[\s\p{Z}]"
NORM_SQL = rf"""n AS (SELECT doc_id, lang, source, text, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(0), ''), '[ \t]+', ' ', 'g'), '\n{{4,}}', chr(10)||chr(10)||chr(10), 'g'), '^{WS}+|{WS}+$', '', 'g') AS norm FROM documents)"""
TOKENS_SQL = "t AS (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM documents)"


@query(f"WITH {NORM_SQL} SELECT doc_id, length(norm) AS n_chars, md5(norm) AS norm_md5 FROM n")
def text_normalize(t, spark, sf):
    """I5"""
    norm = t("documents").select("doc_id", tx.normalize_text(F.col("text")).alias("norm"))
    return norm.select("doc_id", F.length("norm").cast("long").alias("n_chars"), F.md5(F.col("norm").cast("binary")).alias("norm_md5"))


@query(f"WITH {TOKENS_SQL} SELECT doc_id, len(toks) AS n_tokens, sha256(array_to_string(toks, ' ')) AS digest, sha256(array_to_string(toks, ' '))[1:16] AS short FROM t")
def token_digest(t, spark, sf):
    """I6, I10"""
    d = t("documents").select("doc_id", tx.dedup_tokens(F.col("text")).alias("k")).withColumn("digest", tx.digest(F.array_join("k", " ")))
    return d.select("doc_id", F.size("k").cast("long").alias("n_tokens"), "digest", F.substring("digest", 1, 16).alias("short"))


@query(f"""WITH {ATTACHMENTS_SQL} SELECT filename, lower(regexp_extract(filename, '[^.].*?(\\.[^.]+)$', 1)) AS suffix, trim(regexp_replace(translate(lower(filename), '_-', '  '), '\\s+', ' ', 'g')) AS norm, count(*) AS n FROM att GROUP BY ALL""")
def filename_forms(t, spark, sf):
    """I15-I17, C9"""
    a = attachments(t).groupBy("filename").agg(F.count(F.lit(1)).alias("n"))
    return a.select("filename", tx.file_suffix(F.col("filename")).alias("suffix"), tx.normalize_name(F.col("filename")).alias("norm"), "n")


CLASSIFY_SQL = f"""WITH {ATTACHMENTS_SQL}, s AS (SELECT *, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Laporan Keuangan Tahunan' ELSE 'Keterbukaan' END AS title,
 lower(regexp_extract(filename, '[^.].*?(\\.[^.]+)$', 1)) AS suffix, trim(regexp_replace(translate(lower(filename), '_-', '  '), '\\s+', ' ', 'g')) AS norm FROM att JOIN orders ON o_orderkey = announcement_id),
f AS (SELECT *, title LIKE 'Laporan%' AS smart, CASE WHEN suffix = '.zip' THEN 'machine_package' WHEN suffix NOT IN ('.pdf','.xlsx','.docx') THEN 'unsupported' WHEN title NOT LIKE 'Laporan%' THEN 'general_source'
 WHEN suffix = '.xlsx' THEN 'sheet' WHEN suffix = '.pdf' AND norm LIKE '%checklist%' THEN 'administrative' WHEN suffix = '.pdf' AND norm LIKE '%laporan keuangan%' THEN 'primary'
 WHEN suffix = '.pdf' AND (norm LIKE '%financialstatement%' OR norm LIKE '%financial statement%') THEN 'generic' ELSE 'supporting' END AS first FROM s),
g AS (SELECT *, smart AND suffix = '.pdf' AND norm NOT LIKE '%checklist%' AND NOT is_attachment AS opaque FROM f),
w AS (SELECT *, sum((first = 'primary')::INT) OVER p AS np, sum((first = 'generic')::INT) OVER p AS ng, sum(opaque::INT) OVER p AS nm,
 row_number() OVER (PARTITION BY announcement_id, first ORDER BY is_attachment::INT, position, filename) AS rk FROM g WINDOW p AS (PARTITION BY announcement_id)),
c AS (SELECT announcement_id, filename, CASE WHEN first IN ('sheet','primary') OR (first = 'generic' AND np = 0 AND rk = 1) OR (opaque AND np = 0 AND ng = 0 AND nm = 1) THEN 'financial_statement'
 WHEN first = 'generic' THEN 'financial_statement_duplicate' ELSE first END AS category FROM w)"""


def _titled(t):
    title = F.when(F.col("title").isin("1-URGENT", "2-HIGH"), "Laporan Keuangan Tahunan").otherwise("Keterbukaan")
    a = announcements(t).select(F.col("id2").alias("announcement_id"), title.alias("title"))
    return attachments(t).join(a, "announcement_id")


@query(f"{CLASSIFY_SQL} SELECT category, category IN ('financial_statement','general_source') AS selected, count(*) AS n, count(DISTINCT announcement_id) AS announcements FROM c GROUP BY ALL")
def financial_select(t, spark, sf):
    """C8, C10"""
    out = selection.classify(_titled(t), ["announcement_id"])
    return out.groupBy("category", "selected").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("announcement_id").alias("announcements"))


@query(f"""{CLASSIFY_SQL} SELECT announcement_id, count(*) FILTER (WHERE category IN ('financial_statement','general_source')) AS selected, bool_and(category NOT IN ('financial_statement','general_source') OR filename LIKE '%.pdf') AS ready FROM c GROUP BY 1""")
def refine_preview(t, spark, sf):
    """An announcement is ready only if every selected source is cached"""
    out = selection.classify(_titled(t), ["announcement_id"]).withColumn("cached", F.col("filename").endswith(".pdf"))
    return out.groupBy("announcement_id").agg(F.count_if("selected").alias("selected"), F.bool_and(~F.col("selected") | F.col("cached")).alias("ready"))


@query("""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Public  EXPOSE ' WHEN doc_id % 7 = 0 THEN 'Financial Statement ' ELSE '' END || split_part(text, chr(10), 1) AS title FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'public_expose' WHEN doc_id % 7 = 0 THEN 'financial_report' ELSE 'general' END AS cls FROM x""")
def disclosure_class(t, spark, sf):
    """C11, I28"""
    lead = F.when(F.col("doc_id") % 5 == 0, "Public  EXPOSE ").when(F.col("doc_id") % 7 == 0, "Financial Statement ").otherwise("")
    title = F.concat(lead, F.split("text", "\n")[0])
    return t("documents").select("doc_id", selection.disclosure_class(title).alias("cls"))


TRIAGE_RISKS = {"insult": "(?i)idiot|moron", "capital-on": r"(?i)on\s+the\s+of", "the-the": r"(?is)\bthe\b.{0,40}\bthe\b.{0,40}\bthe\b"}


@query("""WITH x AS (SELECT event_id, 'holder ' || event_type || ' ' || (event_id % 60) || ',5% then ' || (event_id % 60 + (event_id % 4) * 0.05)::DECIMAL(6,2) || ' % of shares' AS line FROM events),
p AS (SELECT event_id, list_transform(regexp_extract_all(line, '(?:^|[^0-9])([0-9]{1,3}(?:[.,][0-9]{1,4})?)\\s*%', 1), lambda v: replace(v, ',', '.')::DOUBLE) AS v FROM x)
SELECT event_id, list_min(v) AS low, list_max(v) AS high FROM p WHERE len(v) >= 2 AND list_max(v) - list_min(v) >= 0.4""")
def numeric_delta(t, spark, sf):
    """C14, E18, I18"""
    shares = (F.col("event_id") % 60 + (F.col("event_id") % 4) * F.expr("0.05BD")).cast("decimal(6,2)").cast("string")
    line = F.concat(F.lit("first line\nholder "), F.col("event_type"), F.lit(" "), (F.col("event_id") % 60).cast("string"), F.lit(",5% then "), shares, F.lit(" % of shares\nholder 1% 99%"))
    line = F.substring_index(line, "\n", 2)
    d = t("events").select("event_id", triage.delta_signal(line, 0.4, "(?i)holder").alias("s")).where("s is not null")
    return d.select("event_id", "s.low", "s.high")


@query(f"WITH {TOKENS_SQL}, d AS (SELECT doc_id, sha256(array_to_string(toks, ' ')) AS digest FROM t) SELECT digest, count(*) AS copies, min(doc_id) AS first_doc FROM d GROUP BY 1 HAVING count(*) >= 2")
def exact_duplicates(t, spark, sf):
    """exact"""
    return dedup.exact_groups(t("documents").select("doc_id", tx.digest(F.array_join(tx.dedup_tokens(F.col("text")), " ")).alias("digest")))


NEAR_SQL = f"""WITH RECURSIVE {TOKENS_SQL}, b AS (SELECT doc_id, lang, len(toks) AS n, array_to_string(toks, ' ') AS norm, list_distinct(list_transform(range(1, len(toks) - 3), lambda i: array_to_string(toks[i:i+4], ' '))) AS sh FROM t WHERE len(toks) >= 120),
e AS (SELECT lang, doc_id, n, unnest(sh) AS g FROM b), i AS (SELECT x.lang, x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.lang = y.lang AND x.g = y.g AND x.doc_id < y.doc_id AND least(x.n, y.n) >= 0.94 * greatest(x.n, y.n) GROUP BY ALL),
pairs AS (SELECT i.lang, a, b, CASE WHEN x.norm = y.norm THEN 1.0 ELSE greatest(CASE WHEN length(x.norm) <= length(y.norm) AND contains(y.norm, x.norm) THEN length(x.norm) / length(y.norm) WHEN contains(x.norm, y.norm) THEN length(y.norm) / length(x.norm) ELSE 0 END, c / (len(x.sh) + len(y.sh) - c)) END AS similarity
 FROM i JOIN b x ON x.doc_id = a JOIN b y ON y.doc_id = b), near AS (SELECT * FROM pairs WHERE similarity >= 0.8)"""


def _docs(t):
    return dedup.fingerprints(t("documents").select("doc_id", "lang", "source", "text", F.lit(".txt").alias("suffix")))


@query(f"{NEAR_SQL} SELECT lang, a, b, similarity FROM near")
def near_dup_pairs(t, spark, sf):
    """Documents without a language are alike none"""
    return dedup.near_pairs(_docs(t).where("lang is not null"), ["lang"], 0.8)


@query(f"""{NEAR_SQL}, alike AS (SELECT a, b FROM near WHERE (a % 3 = 0) = (b % 3 = 0) UNION SELECT x.doc_id, y.doc_id FROM documents x JOIN documents y ON x.lang = y.lang AND x.text = y.text AND x.doc_id < y.doc_id),
rr AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY len(toks) DESC, doc_id) AS rk FROM t),
adj AS (SELECT rr.lang, rr.rk, rr.doc_id, coalesce(list(n.o) FILTER (WHERE n.o IS NOT NULL), []) AS nb FROM rr LEFT JOIN (SELECT a AS d, b AS o FROM alike UNION ALL SELECT b, a FROM alike) n ON n.d = rr.doc_id GROUP BY ALL),
g(lang, rk, doc_id, keep, kept) AS (SELECT lang, rk, doc_id, true, [doc_id] FROM adj WHERE rk = 1 UNION ALL
 SELECT adj.lang, adj.rk, adj.doc_id, NOT list_has_any(g.kept, adj.nb), CASE WHEN list_has_any(g.kept, adj.nb) THEN g.kept ELSE list_append(g.kept, adj.doc_id) END FROM g JOIN adj ON adj.lang = g.lang AND adj.rk = g.rk + 1)
SELECT doc_id, keep FROM g""")
def near_dup_greedy(t, spark, sf):
    """Equal files whatever their suffix and length, near copies within a suffix"""
    suffix = F.when(F.col("doc_id") % 3 == 0, ".xlsx").otherwise(".pdf")
    docs = _docs(t).withColumns({"suffix": suffix, "file_hash": tx.digest(F.col("text"))})
    return dedup.suppress(docs, ["lang"], 0.8, [-F.col("n_tokens"), F.col("doc_id")]).select("doc_id", "keep")


CHUNK_SQL = """WITH RECURSIVE c(doc_id, text, lo, nxt, k) AS (SELECT doc_id, text, 0, 0, 0 FROM documents UNION ALL
 SELECT doc_id, text, nxt, CASE WHEN length(text) - nxt <= 5000 THEN length(text) ELSE nxt + CASE WHEN 5000 - strpos(reverse(text[nxt+1:nxt+5000]), chr(10)) > 2500 AND strpos(reverse(text[nxt+1:nxt+5000]), chr(10)) > 0 THEN 5000 - strpos(reverse(text[nxt+1:nxt+5000]), chr(10)) ELSE 5000 END END, k + 1
 FROM c WHERE nxt < length(text) OR k = 0), x AS (SELECT doc_id, k AS chunk_index, text[lo+1:nxt] AS chunk, max(k) OVER (PARTITION BY doc_id) AS chunk_count FROM c WHERE k > 0)"""


@query(f"{CHUNK_SQL} SELECT doc_id, chunk_index, chunk_count, sha256(chunk) AS chunk_sha, length(chunk) AS n_chars FROM x")
def chunk_plan(t, spark, sf):
    """U3, F8"""
    out = digest.chunk(t("documents").select("doc_id", "text"), size=5000)
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("chunk_count").cast("long").alias("chunk_count"), "chunk_sha", F.length("chunk").cast("long").alias("n_chars"))


@query(f"{CHUNK_SQL} SELECT doc_id, chunk_index, sha256(chunk) AS chunk_sha FROM x WHERE NOT (doc_id % 3 = 0 AND (doc_id % 2 = 0 OR chunk_index > 1))")
def chunk_pending(t, spark, sf):
    """U4, E8"""
    plan = digest.chunk(t("documents").select("doc_id", "text"), size=5000)
    cache = plan.where("doc_id % 3 = 0").withColumn("chunk_sha", F.when((F.col("doc_id") % 2 == 0) | (F.col("chunk_index") > 1), F.col("chunk_sha")).otherwise("stale"))
    return digest.pending_chunks(plan, cache, ["doc_id"]).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_sha")


@query(rf"""{CHUNK_SQL}, m AS (SELECT doc_id, chunk_index, length(chunk) AS nc, regexp_extract(chunk, '^([^.\n]*\.?)', 1) AS lead, len(list_filter(regexp_split_to_array(chunk, '\s+'), lambda w: w <> '')) AS nw FROM x),
d AS (SELECT lang, doc_id, sum(nc)::BIGINT AS n_chars, sum(nw)::BIGINT AS n_words, min_by(lead, chunk_index) AS lead, count(*) AS chunks FROM m JOIN documents USING (doc_id) GROUP BY ALL)
SELECT lang, count(*) AS documents, sum(chunks)::BIGINT AS chunks, sum(n_chars)::BIGINT AS n_chars, sum(n_words)::BIGINT AS n_words, min_by(lead, doc_id) AS lead FROM d GROUP BY 1""")
def doc_map_reduce(t, spark, sf):
    """U5, U6"""
    return digest.map_reduce(t("documents"), "lang", "doc_id", size=5000)


@query("""WITH c AS (SELECT o_custkey AS ticker, count(*) FILTER (WHERE o_orderstatus = 'F') AS n, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'F'), '') AS fp FROM orders GROUP BY 1)
SELECT ticker, n, CASE WHEN n = 0 THEN 'skip_no_evidence' WHEN ticker % 4 = 0 THEN 'cache_hit' WHEN n = 1 AND ticker % 2 = 1 THEN 'promote_single' ELSE 'rebuild' END AS action FROM c""")
def company_plan(t, spark, sf):
    """U9, U10"""
    f = F.col("status") == "F"
    ids = F.array_join(F.array_sort(F.collect_list(F.when(f, F.col("id2")))), ",")
    w = announcements(t).groupBy("ticker").agg(F.count_if(f).alias("n"), ids.alias("fingerprint"))
    w = w.withColumns({"saved_fingerprint": F.when(F.col("ticker") % 4 == 0, F.col("fingerprint")).otherwise("old"), "promote": F.col("ticker") % 2 == 1})
    return digest.company_plan(w).select("ticker", "n", "action")


@query("""WITH r AS (SELECT l_orderkey AS announcement_id, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_quantity < 48 AND NOT l_linestatus = 'F') AS pending, bool_or(l_discount > 0.09) AS updated, bool_or(l_linenumber = 1) AS cached FROM lineitem GROUP BY 1)
SELECT announcement_id, pending, CASE WHEN pending > 0 THEN 'wait' WHEN cached AND NOT updated THEN 'reuse' ELSE 'reduce' END AS action FROM r""")
def reduce_trigger(t, spark, sf):
    """U21"""
    d = t("lineitem").select(
        F.col("l_orderkey").alias("announcement_id"), ((F.col("l_returnflag") == "R") | (F.col("l_linestatus") == "F")).alias("valid"), (F.col("l_quantity") >= 48).alias("failed"),
        (F.col("l_discount") > 0.09).alias("updated"), (F.col("l_linenumber") == 1).alias("cached"),
    )
    return digest.reduce_action(d, "announcement_id").select("announcement_id", "pending", "action")


@query("SELECT doc_id, CASE WHEN l.quality = 1 THEN 'reuse_text' WHEN l.doc_id IS NOT NULL THEN 'extract' ELSE 'fetch' END AS action FROM documents LEFT JOIN labels l USING (doc_id)")
def reuse_action(t, spark, sf):
    """U20"""
    d = t("documents").select("doc_id").join(t("labels").withColumn("have", F.lit(True)), "doc_id", "left")
    return d.select("doc_id", digest.reuse_action(F.coalesce("have", F.lit(False)), F.coalesce(F.col("quality") == 1, F.lit(False))).alias("action"))


@query("""SELECT o_custkey AS ticker, count(*) AS n, sha256('{"lineage":["model-a","v1"],"rows":[' || string_agg(json_object('id2', o_orderkey, 'status', o_orderstatus, 'title', o_orderpriority)::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey)
 || '],"ticker":' || o_custkey || '}') AS fingerprint FROM orders GROUP BY 1""")
def input_fingerprint(t, spark, sf):
    """U8, I11, I20"""
    rows = announcements(t)
    return digest.input_fingerprint(rows, ["ticker"], ["announced_at", "id2"], ["id2", "title", "status"], ["model-a", "v1"])


@query("""WITH s AS (SELECT o_custkey, any_value(o_orderkey) AS id, any_value(o_orderpriority) AS p, any_value(o_orderstatus) AS st, any_value(o_orderdate) AS d FROM orders GROUP BY 1 HAVING count(*) = 1)
SELECT upper('c' || o_custkey) AS ticker, id AS announcement_id, 1 AS announcement_count, 'Filing ' || p AS overview, 'material_change:' || p || ';risk_or_uncertainty:' || st AS claims FROM s""")
def promote_single(t, spark, sf):
    """U7"""
    a = announcements(t)
    one = a.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("id2", "title", "status", "announced_at")]).where("n = 1")
    s = one.select(
        F.concat(F.lit(" c"), F.col("ticker").cast("string")).alias("ticker"), F.col("id2").alias("announcement_id"), "announced_at", "title",
        F.concat(F.lit(" Filing "), F.col("title")).alias("executive_summary"), F.array("title", F.concat(F.col("title"), F.lit(" ")), F.lit(" ")).alias("material_facts"), F.array("status").alias("risks_or_uncertainties"),
    )
    out = digest.promote_single(s)
    return out.select("ticker", "announcement_id", "announcement_count", "overview", F.array_join(F.transform("claims", lambda c: F.concat_ws(":", c["category"], c["claim"])), ";").alias("claims"))


@query("SELECT event_id, json_keys(props) = ['k'] AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS valid FROM events")
def schema_valid(t, spark, sf):
    """JVM-side for flat objects"""
    return t("events").select("event_id", validate.flat_object_ok(F.col("props"), ["k"]).alias("valid"))


@query("SELECT event_id, CASE WHEN json_keys(p) <> ['k'] THEN '$: missing k' WHEN event_id % 7 = 0 THEN '$.k: type' WHEN json_extract(p, '$.k')::INT < 10 THEN '$.k: minimum' END AS error FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{\"z\": 1}' WHEN event_id % 7 = 0 THEN '{\"k\": true}' ELSE props END AS p FROM events)")
def schema_errors(t, spark, sf):
    """Nested schemas in Arrow batches"""
    schema = {"type": "object", "properties": {"k": {"type": "integer", "minimum": 10}}, "required": ["k"], "additionalProperties": False}
    p = F.when(F.col("event_id") % 5 == 0, '{"z": 1}').when(F.col("event_id") % 7 == 0, '{"k": true}').otherwise(F.col("props"))
    return validate.validated(t("events").select("event_id", p.alias("p")), "p", schema).select("event_id", "error")


@query("SELECT n_name, lower(regexp_replace(n_name, '[^A-Za-z0-9]+', '-', 'g')) AS slug, 'Dear ' || n_name || ', {keep} region ' || n_regionkey || '.' AS letter, ['missing', 'name', 'region'] AS used FROM nation")
def template_render(t, spark, sf):
    """I16, I19"""
    template = F.lit("Dear {name}, {keep} region {region}{missing}.")
    values = F.create_map(F.lit("name"), F.col("n_name"), F.lit("keep"), F.lit("{keep}"), F.lit("region"), F.col("n_regionkey").cast("string"))
    used = F.array_except(tx.placeholders(template), F.array(F.lit("keep")))
    return t("nation").select("n_name", tx.slug(F.col("n_name")).alias("slug"), tx.render_template(template, values).alias("letter"), used.alias("used"))


@query("""WITH o AS (SELECT user_id, event_id, ts, value, event_type <> 'error' AND event_id % 3 <> 0 AS ok, event_id % 2 = 0 AS net FROM events), e AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ep FROM o),
s AS (SELECT *, sum((NOT ok AND net)::INT) OVER (PARTITION BY user_id, ep ORDER BY ts, event_id)::BIGINT AS streak FROM e)
SELECT event_id, user_id, streak, max((streak >= 3)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS open FROM s""")
def circuit_breaker(t, spark, sf):
    """U10, C20"""
    o = t("events").select("user_id", "event_id", "ts", ((F.col("event_type") != "error") & (F.col("event_id") % 3 != 0)).alias("ok"), (F.col("event_id") % 2 == 0).alias("network"))
    return digest.circuit_breaker(o, ["user_id"], ["ts", "event_id"], 3).select("event_id", "user_id", "streak", "open")


@query("SELECT s_suppkey, least(60.0, pow(2.0, s_suppkey % 9)) AS wait, s_nationkey % 5 + 1 AS attempt FROM supplier")
def backoff_schedule(t, spark, sf):
    """I24, I25"""
    return t("supplier").select("s_suppkey", digest.backoff(F.col("s_suppkey") % 9 + 1).alias("wait"), (F.col("s_nationkey") % 5 + 1).alias("attempt"))


@query("SELECT 'overview,timeline,limitations' AS chosen, 13 AS known")
def section_order(t, spark, sf):
    """C21, H7"""
    names = library.sections(["limitations", "overview", "timeline", "overview"], [])
    return t("region").where("r_regionkey = 0").select(F.lit(",".join(names)).alias("chosen"), F.lit(len(library.SECTIONS)).alias("known"))
