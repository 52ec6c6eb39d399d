"""Claims of saved company summaries, read as VARIANT whatever shape they have, and what each can be traced to."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.lineage import cut
from tidemark.operators.provenance import match_sources

# The fields of a company summary that hold claims, and what kind of claim each holds.
CLAIM_FIELDS = {
    "material_changes": "material_change",
    "key_financial_figures": "financial_figure",
    "corporate_actions": "corporate_action",
    "expansion_projects": "expansion_project",
    "management_or_control_changes": "management_or_control_change",
    "capital_structure_events": "capital_structure_event",
    "listing_or_regulatory_events": "listing_or_regulatory_event",
    "analytical_scenarios": "analytical_scenario",
    "risks_or_uncertainties": "risk_or_uncertainty",
    "items_to_monitor": "item_to_monitor",
}


@F.pandas_udf(StringType())
def _sorted_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True))


def with_claims(rows: DataFrame) -> DataFrame:
    """``rows`` (value, ...) with ``claim``, the text of a claim: a string itself; of an object its analysis, else metric, value and period,
    else the object as JSON with sorted keys; of anything else its value. Only objects that come to the last resort are sent to Python."""
    v, kind = F.col("value"), F.col("_kind")
    is_object = kind.startswith("OBJECT")
    # Absent, null, empty, zero and false values say nothing; a string that reads like one of them does.
    text = lambda path: F.try_variant_get(v, path, "string")
    told = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.lit(False))
    said = lambda path: F.when((text(path) != "") & (told(path) | ~text(path).isin("0", "false", "[]", "{}")), text(path))
    trim = lambda c: F.trim(c, F.lit(" \t\n\x0b\x0c\r"))
    figure = F.when(F.coalesce(said("$.metric"), said("$.value")).isNotNull(), F.concat_ws(" — ", said("$.metric"), said("$.value"), said("$.period")))
    named = F.when(is_object, F.coalesce(trim(said("$.analysis")), figure))
    other = F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(F.to_json(v))).when(kind == "STRING", trim(F.try_variant_get(v, "$", "string"))).otherwise(F.to_json(v))
    # Each step reads the one before as a column, so that nothing is taken out of the value twice.
    steps = rows.withColumn("_kind", F.schema_of_variant(v)).withColumn("_named", named)
    last = _sorted_json(F.when(is_object & F.col("_named").isNull(), F.to_json(v)))
    return steps.withColumn("claim", F.when(is_object, F.coalesce("_named", last)).otherwise(other)).drop("_kind", "_named")


def claims_as_told(summaries: DataFrame, company: str, summary: str) -> DataFrame:
    """``claim_rows`` with the claims that have no text."""
    parsed = summaries.select(F.col(company).alias("company"), F.try_parse_json(summary).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    rows = summaries.sparkSession.sql(
        "SELECT s.company, f.key AS field, e.pos AS place, e.value FROM {s} s, LATERAL variant_explode(s.v) f, LATERAL variant_explode(f.value) e WHERE e.key IS NULL", s=parsed
    )
    category = F.element_at(F.create_map(*[F.lit(x) for pair in CLAIM_FIELDS.items() for x in pair]), F.col("field"))
    return with_claims(rows.where(F.col("field").isin(*CLAIM_FIELDS))).select("company", "field", category.alias("category"), "place", "claim",
                                                                              F.coalesce(F.nullif(F.try_variant_get("value", "$.classification", "string"), F.lit("")), F.lit("explicit_fact")).alias("classification"))


def claim_rows(summaries: DataFrame, company: str, summary: str) -> DataFrame:
    """company, field, category, place, claim and classification of every claim of ``summary`` (JSON text) of each company. Fields that hold
    no list, and summaries that are no object, have none; a claim without text is none."""
    return claims_as_told(summaries, company, summary).where("claim <> ''")


def claim_references(summaries: DataFrame, company: str, summary: str) -> DataFrame:
    """company, claim, ids, classification and rationale of the sources that a summary names itself; of several for one claim the last."""
    parsed = summaries.select(F.col(company).alias("company"), F.try_parse_json(summary).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    rows = summaries.sparkSession.sql("SELECT s.company, e.pos, e.value FROM {s} s, LATERAL variant_explode(try_variant_get(s.v, '$.claim_sources', 'variant')) e WHERE e.key IS NULL", s=parsed)
    get = lambda path, kind="string": F.try_variant_get("value", path, kind)
    read = rows.select("company", "pos", F.trim(get("$.claim")).alias("claim"), F.coalesce(get("$.announcement_ids", "array<string>"), F.array().cast("array<string>")).alias("ids"),
                       F.nullif(get("$.classification"), F.lit("")).alias("_class"), F.coalesce(get("$.rationale"), F.lit("")).alias("rationale")).where("claim <> ''")
    last = F.max_by(F.struct("ids", "_class", "rationale"), "pos").alias("r")
    return read.groupBy("company", "claim").agg(last).select("company", "claim", "r.*")


def trace_claims(summaries: DataFrame, announcements: DataFrame, company: str, summary: str) -> DataFrame:
    """``claim_rows`` with attribution, match_score, rationale and source_ids. ``announcements``: company, id2 and text (what its saved summary
    says).

    A claim that the summary gives sources for has those that are the company's; else, of a company with one announcement, that;
    else the one or two whose tokens fit best.
    """
    keys = ["company", "field", "place"]
    # Filtered when read: a filter below the table would make each claim twice.
    claims = cut(claims_as_told(summaries, company, summary), "claims").where("claim <> ''")
    refs = claim_references(summaries, company, summary)
    known = announcements.select("company", F.col("id2").cast("string").alias("id2"))
    sizes = known.groupBy("company").agg(F.count(F.lit(1)).alias("_all"), F.min("id2").alias("_only"))
    marked = cut(claims.join(refs, ["company", "claim"], "left").join(sizes, "company", "left"), "claims")
    wanted = marked.where("ids is not null").select(*keys, F.posexplode("ids").alias("_at", "id2"))
    named = wanted.join(known.distinct(), ["company", "id2"], "left_semi").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "id2"))), lambda x: x["id2"]).alias("_named"))
    apart = marked.where("ids is null and _all > 1").select("company", F.struct("field", "place").alias("_claim"), F.col("claim").alias("text"))
    texts = announcements.select("company", F.col("id2").cast("string").alias("id2"), "text")
    best = match_sources(apart, texts, "_claim", "id2", group=["company"])
    found = best.groupBy("company", "_claim").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id2"))), lambda x: x["id2"]).alias("_found"), F.max("score").alias("_score"))
    found = found.select("company", "_claim.field", "_claim.place", "_found", "_score")
    out = marked.join(named, keys, "left").join(found, keys, "left")
    single = F.col("ids").isNull() & (F.col("_all") == 1)
    ids = F.when(F.col("ids").isNotNull(), F.col("_named")).when(single, F.array("_only")).otherwise(F.col("_found"))
    how = F.when(F.col("ids").isNotNull(), F.when(F.col("_named").isNotNull(), "exact_model_reference")).when(single, "deterministic_single_announcement").when(F.col("_found").isNotNull(), "inferred_from_saved_summaries")
    return out.select(
        *keys, "category", "claim", F.coalesce("_class", "classification").alias("classification"), F.coalesce(how, F.lit("unresolved")).alias("attribution"),
        F.when(single, 1.0).when(F.col("ids").isNull(), F.col("_score")).alias("match_score"), F.coalesce("rationale", F.lit("")).alias("rationale"),
        F.coalesce(ids, F.array().cast("array<string>")).alias("source_ids"),
    )
