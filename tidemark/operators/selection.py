"""Which attachments of an announcement are read, and what kind of disclosure it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import file_suffix, normalize_name

# Substrings of normalised titles and file names, and supported suffixes.
FINANCIAL_TITLES = ["laporan keuangan", "financial statement"]
PUBLIC_EXPOSE = [
    "paparan publik", "public expose", "public exposure", "investor meeting", "investor presentation", "pemaparan kinerja",
    "presentasi investor", "materi investor",
]
ADMINISTRATIVE = [
    "checklist", "check list", "surat pernyataan", "pernyataan direksi", "pernyataan manajemen", "management statement",
    "director statement", "pengungkapan lk",
]
PRIMARY_PDF = ["laporan keuangan", "lap keuangan"]
PRIMARY_PDF_WORD = r"(^|\s)lk(tt)?(\s|$)"
GENERIC_PDF = ["financial statement", "financialstatement"]
SUPPORTED = [".pdf", ".xlsx", ".xlsm", ".docx", ".html", ".htm", ".txt", ".csv", ".json", ".xml"]
SHEETS = [".xlsx", ".xlsm"]


def any_of(x: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.contains(x, F.lit(p))
    return out


def is_financial(title: Column) -> Column:
    return any_of(normalize_name(title), FINANCIAL_TITLES)


def disclosure_class(title: Column) -> Column:
    flat = F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("")))), r"\s+", " ")
    return F.when(any_of(flat, PUBLIC_EXPOSE), "public_expose").when(any_of(flat, FINANCIAL_TITLES), "financial_report").otherwise("general")


def classify(attachments: DataFrame, group: list[str], title: str = "title", name: str = "filename", main: str = "is_attachment",
             position: str = "position", policy: str = "smart") -> DataFrame:
    """``attachments`` with ``category`` and ``selected``.

    Each row gets a first verdict; then, for financial announcements, the group settles which PDF stands for the
    statements: a clearly named one, else one generic one, else the only main PDF that isn't administrative.
    """
    suffix, norm = file_suffix(F.col(name)), normalize_name(F.col(name))
    smart = is_financial(F.col(title)) & F.lit(policy == "smart")
    pdf, admin = suffix == ".pdf", any_of(norm, ADMINISTRATIVE)
    primary = any_of(norm, PRIMARY_PDF) | norm.rlike(PRIMARY_PDF_WORD)
    first = (
        F.when(suffix == ".zip", "machine_package")
        .when((suffix != "") & ~suffix.isin(SUPPORTED), "unsupported")
        .when(~smart, "general_source")
        .when(suffix.isin(SHEETS), "sheet")
        .when(pdf & admin, "administrative")
        .when(pdf & primary, "primary")
        .when(pdf & any_of(norm, GENERIC_PDF), "generic")
        .otherwise("supporting")
    )
    # Of equal rows one is chosen, so each has a number of its own.
    rows = attachments.withColumns({"_first": first, "_smart": smart, "_opaque": smart & pdf & ~admin & ~F.col(main).cast("boolean"), "_row": F.monotonically_increasing_id()})
    # Windows of whole groups need no order: a group's first generic row is its least one, and rows are sorted by group once at most.
    whole, generic = Window.partitionBy(*group), F.col("_first") == "generic"
    place = F.struct(F.col(main).cast("int").alias("main"), F.col(position).alias("position"), F.col(name).alias("name"), "_row")
    rows = rows.withColumns({
        "_primary": F.sum((F.col("_first") == "primary").cast("int")).over(whole),
        "_generic": F.sum(generic.cast("int")).over(whole),
        "_mains": F.sum(F.col("_opaque").cast("int")).over(whole),
        "_least": F.min(F.when(generic, place)).over(whole)["_row"],
    })
    chosen = generic & (F.col("_primary") == 0) & (F.col("_row") == F.col("_least"))
    alone = F.col("_opaque") & (F.col("_primary") == 0) & (F.col("_generic") == 0) & (F.col("_mains") == 1)
    category = (
        F.when(F.col("_first").isin("sheet", "primary") | chosen | alone, "financial_statement")
        .when(F.col("_first") == "generic", "financial_statement_duplicate")
        .otherwise(F.col("_first"))
    )
    rows = rows.withColumn("category", category)
    return rows.withColumn("selected", F.col("category").isin("financial_statement", "general_source")).drop(
        "_first", "_smart", "_opaque", "_primary", "_generic", "_mains", "_row", "_least"
    )
