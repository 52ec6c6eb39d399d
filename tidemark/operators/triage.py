"""Routine triage: a report goes the cheap way only if nothing in it hints at a material change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import percents, strip

# Patterns over titles and texts, case ignored; (?s) where a pattern may cross lines.
ROUTINE_TITLE = r"(?i)\blaporan\s+bulanan\s+registrasi\s+pemegang\s+efek\b"
RISKS = {
    "control-change": r"(?i)perubahan\s+(?:pemegang\s+saham\s+)?pengendali|pengambilalihan|menjadi\s+pengendali|tidak\s+lagi\s+menjadi\s+pengendali",
    "director-transaction": r"(?is)(?:direksi|direktur|komisaris).{0,120}(?:membeli|menjual|pembelian|penjualan|transaksi\s+saham|bertambah|berkurang)",
    "share-transaction": r"(?i)(?:transaksi\s+saham|pengalihan\s+saham|penjualan\s+saham|pembelian\s+saham)",
    "ownership-increase": r"(?i)(?:penambahan|kenaikan|bertambahnya)\s+(?:jumlah\s+)?kepemilikan",
    "ownership-decrease": r"(?i)(?:pengurangan|penurunan|berkurangnya)\s+(?:jumlah\s+)?kepemilikan",
    "free-float-breach": r"(?is)free\s*float.{0,120}(?:tidak\s+memenuhi|di\s+bawah|kurang\s+dari|pelanggaran)",
    "treasury-change": r"(?is)(?:saham\s+treasuri|treasury\s+stock).{0,120}(?:bertambah|berkurang|dialihkan|dijual|dibeli)",
}
OWNERSHIP = r"(?i)pemegang|kepemilikan|pengendali|direksi|direktur|komisaris|free\s*float|treasuri"
LONGEST_LINE, EVIDENCE = 1200, 500


def is_routine(title: Column, pattern: str = ROUTINE_TITLE) -> Column:
    return F.coalesce(title, F.lit("")).rlike(pattern)


def delta_signal(text: Column, threshold: float = 0.10, ownership: str = OWNERSHIP) -> Column:
    """struct(low, high, evidence) of the first line about ownership whose percentages differ by the threshold, or null."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    fits = F.filter(lines, lambda x: (F.length(x) <= LONGEST_LINE) & x.rlike(ownership))
    found = F.transform(fits, lambda x: F.struct(percents(x).alias("p"), x.alias("line")))
    wide = F.filter(found, lambda s: (F.size(s["p"]) >= 2) & (F.array_max(s["p"]) - F.array_min(s["p"]) >= threshold))
    first = F.try_element_at(wide, F.lit(1))
    return F.when(
        first.isNotNull(),
        F.struct(F.array_min(first["p"]).alias("low"), F.array_max(first["p"]).alias("high"), F.substring(first["line"], 1, EVIDENCE).alias("evidence")),
    )


def triage(evidence: DataFrame, group: str, title: str = "title", text: str = "text", order: str = "position", most: int = 70_000, least: int = 120,
           threshold: float = 0.10, routine: str = ROUTINE_TITLE, risks: dict[str, str] | None = None, ownership: str = OWNERSHIP) -> DataFrame:
    """One row per group: mode (full or routine_direct), reason, signals (sorted), total_characters, document_count, detail.

    Texts are joined only for groups that pass the cheap tests (title, size, sparseness).
    """
    risks = RISKS if risks is None else risks
    facts = evidence.groupBy(group).agg(
        F.max(title).alias("title"), F.sum(F.length(text)).cast("long").alias("total_characters"), F.count(text).alias("document_count"),
        F.min(F.length(strip(F.col(text)))).alias("_least"),
    )
    odd = (
        F.when(~is_routine(F.col("title"), routine), "not-routine").when(F.col("document_count") == 0, "no-evidence")
        .when(F.col("total_characters") > most, "large-evidence").when(F.col("_least") < least, "sparse-evidence")
    )
    facts = facts.withColumn("_odd", odd)
    open_ = facts.where("_odd is null").select(group)
    joined = evidence.join(open_, group, "left_semi").groupBy(group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "\n").alias("_all")
    )
    named = F.array(*[F.when(F.col("_all").rlike(p), F.lit(name)) for name, p in risks.items()], F.when(F.col("detail").isNotNull(), F.lit("ownership-percentage-delta")))
    scanned = joined.withColumn("detail", delta_signal(F.col("_all"), threshold, ownership)).withColumn("_found", F.array_sort(F.array_distinct(F.array_compact(named)))).drop("_all")
    none = F.array().cast("array<string>")
    signals = F.when(F.col("_odd") == "not-routine", none).when(F.col("_odd").isNotNull(), F.array("_odd")).otherwise(F.coalesce("_found", none))
    out = facts.join(scanned, group, "left").withColumn("signals", signals)
    reason = F.coalesce("_odd", F.when(F.size("signals") > 0, F.lit("material-change")).otherwise(F.lit("clean")))
    mode = F.when(reason == "clean", "routine_direct").otherwise("full")
    return out.select(group, mode.alias("mode"), reason.alias("reason"), "signals", F.coalesce("total_characters", F.lit(0)).cast("long").alias("total_characters"), "document_count", "detail")


def failure_override(decisions: DataFrame, failed: Column) -> DataFrame:
    """An extraction that failed sends a routine report the full way."""
    hit = failed & (F.col("mode") == "routine_direct")
    return decisions.withColumn("signals", F.when(hit, F.array_sort(F.array_append("signals", F.lit("extraction-failure")))).otherwise(F.col("signals"))).withColumn(
        "mode", F.when(hit, F.lit("full")).otherwise(F.col("mode"))
    )
