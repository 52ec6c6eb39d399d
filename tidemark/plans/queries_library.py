"""Library, joins, aggregates and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import library, store
from tidemark.plans.registry import WINDOWS_SQL, announcements, query, windows

LO, HI = "TIMESTAMP '1995-02-10 00:00:00'", "TIMESTAMP '1995-05-20 00:00:00'"


def _range():
    return F.expr(LO.replace("TIMESTAMP", "TIMESTAMP_NTZ")), F.expr(HI.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


@query(f"WITH {WINDOWS_SQL} SELECT start_at, end_at, count(*) AS companies, max(updated_at) AS updated_at FROM w GROUP BY ALL")
def window_index(t, spark, sf):
    """E2, G4"""
    return library.window_index(windows(t))


@query(f"""WITH {WINDOWS_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY end_at DESC, start_at DESC, updated_at DESC) rn
FROM w WHERE end_at >= {LO} AND start_at <= {HI}) SELECT ticker, start_at, end_at, updated_at, n, amount FROM m WHERE rn = 1""")
def share_latest_in_range(t, spark, sf):
    """D10, F1, U14"""
    return library.share_bundle(windows(t), *_range())


@query(f"WITH {WINDOWS_SQL} SELECT * FROM w WHERE end_at >= {LO} AND start_at <= {HI}")
def share_every_window(t, spark, sf):
    """all"""
    return library.share_bundle(windows(t), *_range(), per_ticker="all")


@query(f"WITH {WINDOWS_SQL} SELECT * FROM w WHERE (start_at, end_at) IN (SELECT start_at, end_at FROM w GROUP BY ALL HAVING count(*) % 3 = 0)")
def share_exact_keys(t, spark, sf):
    """D9"""
    keys = library.window_index(windows(t)).where("companies % 3 = 0")
    return library.share_bundle(windows(t), keys=keys, per_ticker="all")


@query(f"""WITH {WINDOWS_SQL}, b AS (SELECT * FROM w WHERE end_at >= {LO} AND start_at <= {HI})
SELECT min(start_at) AS start_at, max(end_at) AS end_at, count(DISTINCT (start_at, end_at)) AS windows, count(DISTINCT ticker) AS companies FROM b""")
def share_covered_span(t, spark, sf):
    """E15"""
    return library.covered_span(library.share_bundle(windows(t), *_range(), per_ticker="all"))


@query(f"""WITH {WINDOWS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY updated_at DESC, end_at DESC, start_at DESC) rn, count(*) OVER (PARTITION BY ticker) AS windows FROM w)
SELECT ticker, windows, start_at, end_at, updated_at FROM r WHERE rn = 1""")
def company_library(t, spark, sf):
    """E4, F2"""
    return library.company_library(windows(t))


@query(f"""WITH {WINDOWS_SQL}, k AS (SELECT DISTINCT start_at, end_at FROM w)
SELECT start_at, end_at, count(o_orderkey) AS announcements FROM k LEFT JOIN orders ON o_orderdate BETWEEN start_at AND end_at GROUP BY ALL""")
def library_window_counts(t, spark, sf):
    """D8, E3"""
    return library.window_counts(windows(t), announcements(t))


@query("""SELECT o_orderkey AS id2, o_orderpriority AS title, d.doc_id, d.quality FROM orders LEFT JOIN labels d ON d.doc_id = o_orderkey AND d.quality = 1 WHERE o_orderstatus = 'F'""")
def announcement_documents(t, spark, sf):
    """D3: the cache's own conditions stay in the join, so announcements without a summary stay too"""
    a = announcements(t).where("status = 'F'").select("id2", "title")
    d = t("labels").select("doc_id", "quality")
    return a.join(d, (F.col("id2") == F.col("doc_id")) & (F.col("quality") == 1), "left")


@query("SELECT o_custkey AS ticker, o_orderkey AS id2, o_orderdate AS announced_at, quality FROM orders JOIN labels ON doc_id = o_orderkey WHERE quality = 1 AND toxic = 0 AND o_orderdate >= TIMESTAMP '1994-01-01'")
def company_announcement_summaries(t, spark, sf):
    """D1, C7"""
    a = announcements(t).where(F.col("announced_at") >= F.expr("TIMESTAMP_NTZ '1994-01-01'")).select("ticker", "id2", "announced_at")
    return a.join(t("labels").where("quality = 1 and toxic = 0").select(F.col("doc_id").alias("id2"), "quality"), "id2").select("ticker", "id2", "announced_at", "quality")


@query("""SELECT event_id, user_id, event_type FROM events WHERE user_id = 7 OR event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')""")
def audit_or_semi(t, spark, sf):
    """A disjunction of an equality and a semi-join, as a flag join so that neither side is a nested loop"""
    hits = t("orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("event_id"), F.lit(True).alias("_hit")).distinct()
    return t("events").select("event_id", "user_id", "event_type").join(hits, "event_id", "left").where((F.col("user_id") == 7) | F.col("_hit")).drop("_hit")


@query("""SELECT (SELECT count(*) FROM orders) AS announcements, (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) AS attachments,
(SELECT count(*) FROM labels JOIN documents USING (doc_id)) AS documents, (SELECT count(DISTINCT o_custkey) FROM orders) AS tickers, (SELECT count(*) FROM conversations) AS chunks""")
def recovery_counts(t, spark, sf):
    """One row of counts, each from its own aggregate"""
    n = F.count(F.lit(1))
    parts = [
        t("orders").agg(n.alias("announcements"), F.count_distinct("o_custkey").alias("tickers")),
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).agg(n.alias("attachments")),
        t("labels").join(t("documents").select("doc_id"), "doc_id").agg(n.alias("documents")), t("conversations").agg(n.alias("chunks")),
    ]
    rows = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:
        rows = rows.join(p.withColumn("_one", F.lit(1)), "_one")  # single rows
    return rows.select("announcements", "attachments", "documents", "tickers", "chunks")


@query("""SELECT o_custkey AS ticker, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderdate, o_orderkey) AS items, count(*) AS n FROM orders GROUP BY 1""")
def nested_announcements(t, spark, sf):
    """D2, E17"""
    out = library.nested(announcements(t), "ticker", ["announced_at", "id2"], ["status"])
    return out.select("ticker", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["id2"].cast("string"), x["status"])), ",").alias("items"), F.size("items").cast("long").alias("n"))


@query("SELECT o_custkey AS ticker, max(o_orderdate) AS latest, count(*) AS n FROM orders GROUP BY 1")
def latest_announcement(t, spark, sf):
    """E1, E16"""
    return announcements(t).groupBy("ticker").agg(F.max("announced_at").alias("latest"), F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT o_custkey AS ticker FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31'")
def tickers_in_window(t, spark, sf):
    """E7, C7"""
    return announcements(t).where(F.col("announced_at").between(F.expr("TIMESTAMP_NTZ '1995-01-01'"), F.expr("TIMESTAMP_NTZ '1995-03-31'"))).select("ticker").distinct()


@query("""WITH x AS (SELECT user_id, event_id, ts, value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_id % 2) DESC, ts DESC, event_id DESC) rn FROM x)
SELECT user_id, event_id, ts, value FROM r WHERE rn = 1""")
def latest_upsert(t, spark, sf):
    """Odd events are new, even ones stored; the newest new row wins"""
    x = t("events").select("user_id", "event_id", "ts", "value")
    return store.upsert(x.where("event_id % 2 = 0"), x.where("event_id % 2 = 1"), ["user_id"], [F.desc("ts"), F.desc("event_id")])


@query("""SELECT p_partkey, p_name, CASE WHEN l.k IS NOT NULL THEN l.n ELSE p_size END AS p_size FROM part LEFT JOIN (SELECT l_partkey AS k, max(l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l.k = p_partkey""")
def partial_update(t, spark, sf):
    """B3"""
    new = t("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_linenumber").alias("p_size"))
    return store.update_columns(t("part").select("p_partkey", "p_name", "p_size"), new, ["p_partkey"], ["p_size"])


@query("""SELECT n.l_orderkey AS announcement_id, bool_or(coalesce((o.l_quantity > 25) <> (n.l_discount > 0.05), false)) AS selection_changed
FROM lineitem n LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber <= 4) o USING (l_orderkey, l_linenumber) GROUP BY 1""")
def attachment_selection_changed(t, spark, sf):
    """B2"""
    x = t("lineitem").select(F.col("l_orderkey").alias("announcement_id"), "l_linenumber", F.col("l_quantity"), F.col("l_discount"))
    old = x.where("l_linenumber <= 4").select("announcement_id", "l_linenumber", (F.col("l_quantity") > 25).alias("selected"))
    new = x.select("announcement_id", "l_linenumber", (F.col("l_discount") > 0.05).alias("selected"))
    return store.changed(old, new, ["announcement_id", "l_linenumber"], "selected", ["announcement_id"])


@query("SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 7)")
def delete_keys(t, spark, sf):
    """B8"""
    return store.delete(t("supplier"), t("lineitem").where("l_quantity = 50 and l_linenumber = 7").select(F.col("l_suppkey").alias("s_suppkey")), ["s_suppkey"])


@query("SELECT doc_id, quality, toxic, 'full' AS analysis_mode, coalesce(nullif(quality, 1), 9) AS level FROM labels")
def schema_migration(t, spark, sf):
    """B16"""
    rows = t("labels").withColumn("level", F.when(F.col("quality") != 1, F.col("quality")))
    return store.with_defaults(rows, {"analysis_mode": ("string", "full"), "level": ("int", 9)})


@query("SELECT doc_id, quality FROM labels WHERE quality = 1 AND toxic = 0")
def versioned_cache_read(t, spark, sf):
    """U19"""
    rows = t("labels").select("doc_id", "quality", F.col("quality").cast("string").alias("model"), F.col("toxic").cast("string").alias("prompt_version"))
    return store.valid_cache(rows, "1", "0").select("doc_id", "quality")


@query("""WITH r AS (SELECT o_custkey AS ticker, o_orderkey AS id2, o_totalprice AS amount, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT ticker, id2, amount, rank FROM r WHERE rank <= 3""")
def slowest_k(t, spark, sf):
    """F9, G5"""
    return library.slowest(announcements(t).select("ticker", "id2", "amount"), ["ticker"], [F.desc("amount"), "id2"], 3).withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT c_custkey AS ticker, '### Filings' || chr(10) || chr(10) || '- ' || string_agg(o_orderpriority || ' ' || o_orderkey, chr(10) || '- ' ORDER BY o_orderkey) || chr(10) AS markdown
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def render_markdown(t, spark, sf):
    """I21"""
    rows = announcements(t).join(t("customer").select(F.col("c_custkey").alias("ticker")), "ticker").select("ticker", "id2", F.concat_ws(" ", "title", F.col("id2").cast("string")).alias("line"))
    return library.markdown_lists(rows, "ticker", "Filings", "line", ["id2"])


@query("""SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000) AS hits, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS promoted,
count(*) FILTER (WHERE o_totalprice > 100000) + count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS calls_avoided FROM orders GROUP BY 1""")
def reducer_stats(t, spark, sf):
    """E13, E14"""
    hits, promoted = F.count_if(F.col("amount") > 100000), F.count_if(F.col("title") == "1-URGENT")
    return announcements(t).groupBy("status").agg(F.count(F.lit(1)).alias("n"), hits.alias("hits"), promoted.alias("promoted"), (hits + promoted).alias("calls_avoided"))
