"""Map, combine, reduce: chunks of documents, documents of announcements, announcements of a company's window."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import digest
from tidemark.lineage import bounded_batches

CHUNK, FINANCIAL_CHUNK = 45_000, 22_000


def cut_points(text: str, size: int) -> list[int]:
    """Ends of chunks: at the last line feed past the middle of each window, which then opens the next chunk, else at its end."""
    ends, at = [], 0
    while len(text) - at > size:
        cut = text.rfind("\n", at, at + size)
        at = cut if cut > at + size // 2 else at + size
        ends.append(at)
    return [*ends, len(text)]


def chunk(docs: DataFrame, text: str = "text", size: int = CHUNK) -> DataFrame:
    """``docs`` without the text, a row for each chunk: chunk_index (from 1), chunk_count, chunk, chunk_sha. Lossless."""
    keep = [c for c in docs.columns if c != text]
    schema = docs.select(*keep).withColumns({"chunk_index": F.lit(1), "chunk_count": F.lit(1), "chunk": F.lit("")}).schema

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ends = [cut_points(t or "", size) for t in frame[text]]
            rows = frame[keep].loc[frame.index.repeat([len(e) for e in ends])].reset_index(drop=True)
            rows["chunk_index"] = [k + 1 for e in ends for k in range(len(e))]
            rows["chunk_count"] = [len(e) for e in ends for _ in e]
            rows["chunk"] = [(t or "")[a:b] for t, e in zip(frame[text], ends, strict=True) for a, b in zip([0, *e], e, strict=False)]
            yield rows

    bounded_batches(docs.sparkSession)
    # Short texts, by far the most, never leave the JVM.
    short = docs.where(F.coalesce(F.length(text), F.lit(0)) <= size).select(*keep, F.lit(1).alias("chunk_index"), F.lit(1).alias("chunk_count"), F.coalesce(F.col(text), F.lit("")).alias("chunk"))
    long = docs.where(F.length(text) > size).mapInPandas(run, schema)
    return short.unionByName(long).withColumn("chunk_sha", digest(F.col("chunk")))


def pending_chunks(plan: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks without a cached summary of the same place, count, text and lineage."""
    return plan.join(cache, [*keys, "chunk_index", "chunk_count", "chunk_sha"], "left_anti")


def extractive(text: Column) -> Column:
    """The deterministic stand-in for a model: length, first sentence and number of words."""
    return F.struct(
        F.length(text).cast("long").alias("n_chars"), F.regexp_extract(text, r"^([^.\n]*\.?)", 1).alias("lead"),
        F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long").alias("n_words"),
    )


def map_reduce(docs: DataFrame, group: str, key: str, text: str = "text", size: int = CHUNK, map_fn: Callable[[Column], Column] = extractive) -> DataFrame:
    """Chunk, map each chunk, combine by document, reduce by group. ``map_fn`` makes a struct from a chunk."""
    mapped = chunk(docs.select(group, key, text), text, size).withColumn("s", map_fn(F.col("chunk")))
    combined = mapped.groupBy(group, key).agg(
        F.sum("s.n_chars").alias("n_chars"), F.sum("s.n_words").alias("n_words"), F.min_by("s.lead", "chunk_index").alias("lead"), F.count(F.lit(1)).alias("chunks")
    )
    return combined.groupBy(group).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("chunks").alias("chunks"), F.sum("n_chars").alias("n_chars"), F.sum("n_words").alias("n_words"),
        F.min_by("lead", key).alias("lead"),
    )


def company_plan(windows: DataFrame) -> DataFrame:
    """``windows`` (count, fingerprint, saved_fingerprint, promote) with ``action``."""
    action = (
        F.when(F.col("n") == 0, "skip_no_evidence").when(F.col("fingerprint") == F.col("saved_fingerprint"), "cache_hit")
        .when((F.col("n") == 1) & F.col("promote"), "promote_single").otherwise("rebuild")
    )
    return windows.withColumn("action", action)


def reduce_action(documents: DataFrame, group: str) -> DataFrame:
    """What an announcement needs: wait for pending documents, reuse, or reduce once all are done."""
    facts = documents.groupBy(group).agg(
        F.count_if(~F.col("valid") & ~F.col("failed")).alias("pending"), F.bool_or("updated").alias("updated"), F.bool_or("cached").alias("cached")
    )
    return facts.withColumn("action", F.when(F.col("pending") > 0, "wait").when(F.col("cached") & ~F.col("updated"), "reuse").otherwise("reduce"))


def reuse_action(has_file: Column, has_text: Column) -> Column:
    return F.when(has_text, "reuse_text").when(has_file, "extract").otherwise("fetch")


def canonical_json(value: Column) -> Column:
    """One text a value: no blanks, nulls written out, so that two different values never read the same."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def input_fingerprint(rows: DataFrame, group: list[str], order: list[str], fields: list[str], lineage: list[str]) -> DataFrame:
    """SHA-256 of lineage and ordered inputs as JSON with sorted keys: equal exactly if a rebuild would read the same."""
    names = sorted(fields)
    taken = F.array_sort(F.collect_list(F.struct(*order, *[c for c in names if c not in order])))
    flat = rows.groupBy(*group).agg(F.transform(taken, lambda r: F.struct(*[r[c].alias(c) for c in names])).alias("rows"), F.count(F.lit(1)).alias("n"))
    facts = {"lineage": F.array(*[F.lit(x) for x in lineage]), "rows": F.col("rows")} | {g: F.col(g) for g in group}
    return flat.select(*group, "n", digest(canonical_json(F.struct(*[facts[k].alias(k) for k in sorted(facts)]))).alias("fingerprint"))


#: Fields of an announcement whose items become claims, and the claims' categories.
CLAIM_FIELDS = {
    "material_facts": "material_change", "corporate_actions": "corporate_action", "expansion_projects": "expansion_project",
    "management_or_control_changes": "management_or_control_change", "capital_structure_events": "capital_structure_event",
    "listing_or_regulatory_events": "listing_or_regulatory_event", "risks_or_uncertainties": "risk_or_uncertainty",
    "possible_investor_relevance": "item_to_monitor",
}


def _claim_of(category: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(x.alias("claim"), F.lit(category).alias("category"))


def promote_single(announcements: DataFrame) -> DataFrame:
    """A window with one announcement takes its summary over: overview, a timeline of one and its claims.

    Claims are distinct by category and text. Scenario items carry their text under ``analysis``, which promotion does
    not read (it looks for ``statement``); so scenarios make no claims, and figures none either: both on purpose.
    """
    have = [c for c in CLAIM_FIELDS if c in announcements.columns]
    claims = F.flatten(F.array(*[
        F.transform(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), _claim_of(CLAIM_FIELDS[c]))
        for c in have
    ]))
    return announcements.where(F.trim("executive_summary") != "").select(
        F.upper(F.trim("ticker")).alias("ticker"), F.lit(1).alias("announcement_count"), F.trim("executive_summary").alias("overview"),
        F.array(F.struct("announced_at", "title", F.trim("executive_summary").alias("summary"))).alias("timeline"), F.array_distinct(claims).alias("claims"), "announcement_id",
    )


# What an error text says of a network fault.
NETWORK_NEEDLES = [
    "openrouter request failed", "connecterror", "connection", "timed out", "timeout", "temporary failure", "network", "429", "502", "503", "504",
]


def circuit_breaker(outcomes: DataFrame, group: list[str], order: list[str], limit: int) -> DataFrame:
    """``outcomes`` (ok, network) with ``streak``, network failures since the last success, and ``open`` from there on."""
    from pyspark.sql import Window

    run = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    epoch = Window.partitionBy(*group, "_epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = outcomes.withColumn("_epoch", F.sum(F.col("ok").cast("int")).over(run)).withColumn("streak", F.sum((~F.col("ok") & F.col("network")).cast("int")).over(epoch))
    return rows.withColumn("open", F.max((F.col("streak") >= limit).cast("int")).over(run) == 1).drop("_epoch")


def failed_on_network(error: Column) -> Column:
    """Does an error text name a network fault?"""
    return F.lower(error).rlike("|".join(NETWORK_NEEDLES))


def retry_reason(error: Column, malformed: Column) -> Column:
    """Why a structured request is tried again."""
    text = F.lower(error)
    return (
        F.when(malformed, "malformed_json").when(text.rlike("429|rate limit|throttl"), "rate_limited").when(text.rlike("timeout|timed out"), "timeout")
        .when(F.contains(text, F.lit("5")) & F.contains(text, F.lit("openrouter request failed")), "provider_error").otherwise("structured_output_error")
    )


def backoff(attempt: Column, first: float = 1.0, most: float = 60.0, retry_after: Column | None = None, remaining: Column | None = None) -> Column:
    """Seconds before an attempt: doubling from ``first`` to ``most``, at least what the server asks, at most what is left."""
    wait = F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), attempt - 1))
    wait = F.greatest(wait, F.coalesce(retry_after, F.lit(0.0))) if retry_after is not None else wait
    return F.least(wait, remaining) if remaining is not None else wait
