"""Where a claim comes from: explicit references, token overlap with saved summaries, and places in the text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import claim_tokens, lower_each
from tidemark.lineage import bounded_batches, cut


def clean_sources(ids: Column, known: Column) -> Column:
    """The known ids of a claim in their order; if none is left and only one is known at all, that one."""
    kept = F.filter(ids, lambda x: F.array_contains(known, x))
    return F.when((F.size(kept) == 0) & (F.size(known) == 1), known).otherwise(kept)


#: Pairs of a claim and a source that a group may have at most to be compared outright.
DIRECT_PAIRS = 256
#: Tokens of all claims that are broadcast at most.
FEW_TOKENS = 20_000


def shared_by_index(claims: DataFrame, sources: DataFrame, claim_id: str, source_id: str, least: float, group: list[str]) -> DataFrame:
    """Score of the pairs that can reach ``least``, by an inverted index.

    A claim of n tokens reaches ``least`` only with ceil(least * n) of them, so one is among its n - ceil(least * n) + 1 rarest: those
    alone form pairs, by an inverted index of the tokens that claims have. A claim's commonest tokens are only counted for
    pairs that stand, by source and token, which no token makes hot. Claims of few tokens go to the sources instead.
    """
    own = claims.select(*group, claim_id, claim_tokens(F.col("text")).alias("_t"))
    said = cut(own.select(*group, claim_id, F.size("_t").alias("_n"), F.explode("_t").alias("tok")), "claim-tokens")
    if not group and said.count() <= FEW_TOKENS:
        return shared_with_few(said, sources, claim_id, source_id, least)
    index = sources.select(*group, source_id, F.explode(claim_tokens(F.col("text"))).alias("tok"))
    index = cut(index.join(said.select(*group, "tok").distinct(), [*group, "tok"], "left_semi"), "source-tokens")
    rarity = index.groupBy(*group, "tok").agg(F.count(F.lit(1)).alias("_df"))
    placed = said.join(rarity, [*group, "tok"], "left").withColumn("_r", F.row_number().over(Window.partitionBy(*group, claim_id).orderBy(F.coalesce("_df", F.lit(0)), "tok")))
    placed = cut(placed.withColumn("_lead", F.col("_r") <= F.col("_n") - F.ceil(F.col("_n") * F.lit(least) - 1e-9) + 1), "claim-prefixes")
    met = placed.where("_lead").join(index, [*group, "tok"]).groupBy(*group, claim_id, source_id).agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    met = cut(met, "claim-pairs")
    more = met.select(*group, claim_id, source_id).join(placed.where("not _lead").select(*group, claim_id, "tok"), [*group, claim_id]).join(index, [*group, source_id, "tok"], "left_semi")
    counted = met.join(more.groupBy(*group, claim_id, source_id).agg(F.count(F.lit(1)).alias("_m")), [*group, claim_id, source_id], "left")
    return counted.select(*group, claim_id, source_id, ((F.col("_c") + F.coalesce("_m", F.lit(0))) / F.col("_n")).alias("score"))


def shared_with_few(said: DataFrame, sources: DataFrame, claim_id: str, source_id: str, least: float) -> DataFrame:
    """Score of the pairs that reach ``least``, of claims (claim_id, _n, tok) that are broadcast: each source meets all of them where it is
    read, so neither tokens nor pairs are shuffled. Of a claim's pairs a task leaves out those below its two best so far,
    which can be neither best nor second."""
    spark = sources.sparkSession
    bounded_batches(spark)
    own = cut(said.groupBy(claim_id).agg(F.collect_list("tok").alias("_t"), F.max("_n").alias("_n")).withColumn("_k", F.monotonically_increasing_id()), "few-claims")
    rows = own.select("_k", "_t", "_n").collect()  # ``FEW_TOKENS`` tokens at most
    postings: dict[str, list[int]] = {}
    for at, row in enumerate(rows):
        for token in row["_t"]:
            postings.setdefault(token, []).append(at)
    index = {token: np.array(claims) for token, claims in postings.items()}
    shared = spark.sparkContext.broadcast((index, np.array([r["_n"] for r in rows], float), np.array([r["_k"] for r in rows], np.int64)))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sizes, keys = shared.value
        best = np.zeros((2, len(sizes)))
        for batch in batches:
            out = []
            for at, tokens in enumerate(batch.column("_t").to_pylist()):
                hits = [index[t] for t in tokens or () if t in index]
                if hits:
                    scores = np.bincount(np.concatenate(hits), minlength=len(sizes)) / sizes
                    found = np.flatnonzero(scores >= np.maximum(best[1], least))
                    best = np.sort(np.vstack([best, scores]), axis=0)[:0:-1]
                    out.append((np.full(len(found), at), keys[found], scores[found]))
            if out:
                at, claims, scores = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.record_batch([pa.array(claims), batch.column("_s").take(pa.array(at)), pa.array(scores)], names=["_k", "_s", "score"])

    kind = sources.schema[source_id].dataType.simpleString()
    found = sources.select(F.col(source_id).alias("_s"), claim_tokens(F.col("text")).alias("_t")).mapInArrow(score, f"_k long, _s {kind}, score double")
    return found.join(F.broadcast(own.select(claim_id, "_k")), "_k").select(claim_id, F.col("_s").alias(source_id), "score")


def shared_in_groups(claims: DataFrame, sources: DataFrame, claim_id: str, source_id: str, group: list[str]) -> DataFrame:
    """Score of all pairs of groups that have few: one shuffle by group brings whole lists of tokens together."""
    said = claims.select(*group, claim_id, claim_tokens(F.col("text")).alias("_t"))
    pairs = said.join(sources.select(*group, source_id, claim_tokens(F.col("text")).alias("_s")), group)
    pairs = pairs.select(*group, claim_id, source_id, F.size(F.array_intersect("_t", "_s")).alias("_c"), F.size("_t").alias("_n"))
    counted = pairs.groupBy(*group, claim_id, source_id).agg(F.sum("_c").alias("_c"), F.max("_n").alias("_n"))
    return counted.select(*group, claim_id, source_id, F.try_divide("_c", "_n").alias("score"))


def match_sources(claims: DataFrame, sources: DataFrame, claim_id: str, source_id: str, least: float = 0.20, slack: float = 0.08, group: list[str] | None = None) -> DataFrame:
    """Best sources of each claim by shared tokens: the best at ``least`` or more, and the second if within ``slack`` of it; inside
    ``group``, if one is given.

    Groups of at most ``DIRECT_PAIRS`` pairs compare all of them; larger ones, and all without a group, go by an inverted index.
    """
    group = group or []
    if group:
        sizes = claims.groupBy(*group).agg(F.count(F.lit(1)).alias("_a")).join(sources.groupBy(*group).agg(F.count(F.lit(1)).alias("_b")), group)
        sizes = cut(sizes.select(*group, (F.col("_a") * F.col("_b") <= DIRECT_PAIRS).alias("_few")), "claim-groups")
        large = sizes.where("not _few").select(*group)
        score = shared_in_groups(claims.join(sizes.where("_few").select(*group), group, "left_semi"), sources, claim_id, source_id, group)
        if not large.isEmpty():
            some = [t.join(large, group, "left_semi") for t in (claims, sources)]
            score = score.unionByName(shared_by_index(*some, claim_id, source_id, least, group))
    else:
        score = shared_by_index(claims, sources, claim_id, source_id, least, group)
    order = Window.partitionBy(*group, claim_id).orderBy(F.desc("score"), F.desc(source_id))
    best = F.first("score").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = score.withColumns({"rank": F.row_number().over(order), "_best": best})
    fits = ((F.col("rank") == 1) & (F.col("score") >= least)) | ((F.col("rank") == 2) & (F.col("_best") >= least) & (F.col("score") >= F.greatest(F.lit(least), F.col("_best") - slack)))
    return ranked.where(fits).select(*group, claim_id, source_id, "score", "rank")


def locate(text: Column, evidence: Column) -> Column:
    """struct(match, line, page, sheet): exact place of the evidence, else whether its squeezed prefix occurs."""
    low, ev = lower_each(text), lower_each(F.trim(evidence))
    at = F.instr(low, ev)
    before = F.substring(text, F.lit(1), at - 1)
    last = lambda p: F.try_element_at(F.regexp_extract_all(before, F.lit(p), F.lit(1)), F.lit(-1))
    squeeze = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    prefix = lower_each(F.substring(squeeze(evidence), 1, 80))
    close = (F.length(prefix) >= 20) & (F.instr(lower_each(squeeze(text)), prefix) > 0)
    match = F.when(at > 0, "exact_text").when(close, "normalized_text").otherwise("not_located")
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    only = lambda x: F.when(at > 0, x)
    return F.struct(
        match.alias("match"), only(line).alias("line"), only(last(r"===== PAGE (\d+) =====").try_cast("int")).alias("page"), only(F.trim(last(r"===== SHEET: (.*?) ====="))).alias("sheet")
    )


def claim_text(text: Column, analysis: Column, metric: Column, value: Column, period: Column) -> Column:
    figure = F.concat_ws(" — ", *[F.when(x != "", x) for x in (metric, value, period)])
    return F.coalesce(F.trim(text), F.when(analysis != "", F.trim(analysis)), F.when(figure != "", figure))


def timeline(parts: list[DataFrame]) -> DataFrame:
    """Events of several kinds (kind, at, ref) in one sequence: by time, nulls first, then kind and ref."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy(F.col("at").asc_nulls_first(), "kind", "ref")
