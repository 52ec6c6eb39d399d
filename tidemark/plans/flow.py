"""The whole flow as DataFrame steps: interval minus coverage, read, accept, store, select, digest, reduce, commit.

Each step is a function from tables to tables, and a job boundary only where a table is written. The source is any
function from a list of ranges to (rows, report); the model is any map from a chunk column to a struct.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import file_suffix
from tidemark.lineage import cut
from tidemark.operators import coverage, dedup, digest, library, selection, store, triage


@dataclass(frozen=True)
class Request:
    """One run: a scope, a closed interval, and how far before a gap to read again."""

    scope: str
    start: datetime
    end: datetime
    snapshot: datetime
    overlap_days: float = 1.0
    keyword: str | None = None
    cap: int | None = None
    model: str = "extractive"
    prompt_version: str = "v1"


@dataclass
class Result:
    gaps: DataFrame
    accepted: DataFrame
    selected: DataFrame
    plans: DataFrame
    digests: DataFrame
    companies: DataFrame
    coverage: DataFrame
    report: dict = field(default_factory=dict)


def plan_reads(request: Request, covered: DataFrame) -> DataFrame:
    """scope, gs, ge, read_from: what is left to read, up to the poll snapshot; no rows mean there is nothing to do."""
    spark = covered.sparkSession
    asked = spark.createDataFrame([(request.scope, request.start, min(request.end, request.snapshot))], "scope string, qs timestamp_ntz, qe timestamp_ntz")
    gaps = coverage.subtract(asked, covered.where(F.col("scope") == request.scope), ["scope"])
    return coverage.widen(gaps, request.overlap_days)


def accept(rows: DataFrame, request: Request, covered: DataFrame, done: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Rows inside the request, outside trusted history, not finished before and, with a list, on it or without ticker."""
    inside = rows.where(F.col("announced_at").between(F.lit(request.start).cast("timestamp_ntz"), F.lit(request.end).cast("timestamp_ntz"))).withColumn("scope", F.lit(request.scope))
    new = coverage.outside(inside, covered.where(F.col("scope") == request.scope), ["scope"], "announced_at").join(done, "id2", "left_anti")
    if listed is not None:
        known = listed.select(F.upper(F.trim("ticker")).alias("_t"), F.lit(True).alias("_listed")).distinct()
        new = new.join(known, F.upper(F.trim("ticker")) == F.col("_t"), "left").where("_listed or coalesce(trim(ticker), '') = ''").drop("_t", "_listed")
    new = new.drop("scope")
    return new.orderBy(F.desc("announced_at"), "id2").limit(request.cap) if request.cap else new


def prepare(accepted: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selected, plans): the attachments that are read, without repeats, and each announcement's mode.

    ``files`` has announcement_id, position, is_attachment, filename, url and text, and may have file_hash.
    """
    titled = files.join(accepted.select(F.col("id2").alias("announcement_id"), "title"), "announcement_id")
    chosen = cut(selection.classify(titled, ["announcement_id"]).where("selected"), "flow-selected")
    file_hash = F.col("file_hash") if "file_hash" in chosen.columns else F.lit(None).cast("string")
    marked = dedup.fingerprints(chosen.select("announcement_id", "url", "text", file_suffix(F.col("filename")).alias("suffix"), file_hash.alias("file_hash"), F.col("url").alias("doc_id"), "is_attachment", "filename"))
    order = [F.col("is_attachment").cast("int"), -F.col("n_tokens"), F.lower("filename"), F.col("doc_id")]
    kept = dedup.suppress(marked, ["announcement_id"], 0.985, order)
    selected = chosen.join(kept.where("keep").select(F.col("doc_id").alias("url")), "url", "left_semi")
    return selected, triage.triage(selected, "announcement_id")


def digest_documents(selected: DataFrame, map_fn: Callable[[Column], Column] = digest.extractive) -> DataFrame:
    return digest.map_reduce(selected, "announcement_id", "url", map_fn=map_fn)


def company_windows(accepted: DataFrame, digests: DataFrame, saved: DataFrame, request: Request) -> DataFrame:
    """ticker, n, fingerprint and action for the window: skip, reuse, promote or rebuild."""
    rows = accepted.join(digests.select(F.col("announcement_id").alias("id2"), "lead"), "id2")
    prints = digest.input_fingerprint(rows, ["ticker"], ["announced_at", "id2"], ["id2", "title", "lead"], [request.model, request.prompt_version])
    every = accepted.select("ticker").distinct().join(prints, "ticker", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    state = every.join(saved.select("ticker", F.col("fingerprint").alias("saved_fingerprint")), "ticker", "left").withColumn("promote", F.lit(True))
    return digest.company_plan(state).select("ticker", "n", "fingerprint", "action")


def commit(request: Request, covered: DataFrame, gaps: DataFrame, complete: bool, errors: int) -> DataFrame:
    """Coverage after the run: the missing ranges are added (not the widened reads), and only if the read proves them."""
    if not complete or errors or request.keyword or request.cap:
        return covered
    added = gaps.select("scope", F.col("gs").alias("s"), F.col("ge").alias("e"), F.lit("runtime").alias("source"))
    other = covered.where(F.col("scope") != request.scope)
    merged = coverage.merge_labelled(covered.where(F.col("scope") == request.scope).unionByName(added), ["scope"], "source", "runtime")
    return other.unionByName(merged.select(*covered.columns))


def run(request: Request, covered: DataFrame, source: Callable[[DataFrame], tuple[DataFrame, dict]], files: DataFrame, done: DataFrame, saved: DataFrame, listed: DataFrame | None = None,
        map_fn: Callable[[Column], Column] = digest.extractive) -> Result:
    """One run from a request to digests and new coverage."""
    gaps = cut(plan_reads(request, covered), "flow-gaps")
    rows, facts = source(gaps)
    fresh = store.latest_per_key(rows, ["id2"], [F.desc("announced_at")])
    accepted = cut(accept(fresh, request, covered, done, listed), "flow-accepted")
    selected, plans = prepare(accepted, files)
    selected = cut(selected, "flow-read")
    digests = cut(digest_documents(selected, map_fn), "flow-digests")
    companies = company_windows(accepted, digests, saved, request)
    after = commit(request, covered, gaps, facts.get("complete", False), facts.get("errors", 0))
    counts = {"gaps": gaps.count(), "accepted": accepted.count(), "digests": digests.count()}
    return Result(gaps, accepted, selected, plans, digests, companies, after, counts | facts)


def recovery_snapshot(announcements: DataFrame, summaries: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """What a window holds by ticker: announcements, and those with a summary."""
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    rows = announcements.where(F.col("announced_at").between(lo, hi)).join(summaries.select(F.col("announcement_id").alias("id2"), F.lit(True).alias("_has")), "id2", "left")
    return rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("announcements"), F.count_if(F.coalesce("_has", F.lit(False))).alias("summarized"))


def share_report(windows: DataFrame, low: datetime | None, high: datetime | None, per_ticker: str = "latest") -> str:
    bound = lambda x: None if x is None else F.lit(x).cast("timestamp_ntz")
    return library.render_bundle(library.share_bundle(windows, bound(low), bound(high), per_ticker=per_ticker))


def company_audit(announcement_ids: DataFrame, attachments: DataFrame, summaries: DataFrame, audits: DataFrame) -> DataFrame:
    """All that happened to a company's announcements, as one timeline."""
    from tidemark.operators.provenance import timeline

    ids = announcement_ids.select("id2")
    near = lambda df, key: df.join(ids.withColumnRenamed("id2", key), key, "left_semi")
    return timeline([
        announcement_ids.select(F.lit("announced").alias("kind"), F.col("announced_at").alias("at"), F.col("id2").cast("string").alias("ref")),
        near(attachments, "announcement_id").select(F.lit("fetched").alias("kind"), F.col("downloaded_at").alias("at"), F.col("url").alias("ref")),
        near(summaries, "announcement_id").select(F.lit("summarized").alias("kind"), F.col("updated_at").alias("at"), F.col("announcement_id").cast("string").alias("ref")),
        near(audits, "announcement_id").select(F.lit("model call").alias("kind"), F.col("started_at").alias("at"), F.col("audit_id").cast("string").alias("ref")),
    ])
