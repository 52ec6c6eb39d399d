"""A corpus pipeline over ``documents``: each stage is one operator, works on all its predecessor kept, and is written
before the next begins.

Stages: language identification (texts it rejects as no language go), line dedup (repeated and nearly repeated lines
go, and documents that had lines and keep none), n-gram Jaccard join (one document of each group stays), mixing to
target weights (documents are drawn zero to three times, in shard order), best-fit packing (token sequences).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.langid import UNKNOWN, fit, identify
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import mixed
from tidemark.llm.ngram_join import deduplicate
from tidemark.llm.packing import best_fit_pack
from tidemark.llm.shared import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language; with nothing to learn languages from, those with a letter."""
    model = fit(docs)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return identify(docs, model).where(F.col("lang_pred") != UNKNOWN).select(*docs.columns)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that stay; ``n_chars`` follows."""
    kept = dedup_lines(docs)
    left = kept.where((F.col("n_lines") == 0) | (F.col("n_lines") > F.col("n_exact") + F.col("n_near")))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard 0.8 or more."""
    return deduplicate(docs).select(*docs.columns)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is drawn, shard by shard in each shard's own order."""
    drawn = mixed(docs)
    return drawn.repartition("shard").sortWithinPartitions("shard", "place").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids, each with its sequence and place."""
    import public_tokenizers

    return best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", known_language),
    ("lines", unique_lines),
    ("near_duplicates", unique_documents),
    ("mix", target_mix),
    ("pack", packed),
]

#: No SQL: kernels, a hypergeometric deal and byte-pair encoding. Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
