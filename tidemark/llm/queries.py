"""The registered queries of this subpackage: thin digests over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ngram_join import ngram_join

    return ngram_join(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copies", F.col("lead").alias("kept"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.line_dedup import dedup_lines

    kept = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_lines", "n_exact", "n_near", (F.col("n_lines") - F.col("n_exact") - F.col("n_near")).alias("n_kept"),
        F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix_sources

    drawn = mix_sources(_table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    return drawn.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("takes")).alias("taken"),
        F.transform("draws", lambda d: d["shard"]).alias("shards"),
    )


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0, k=20)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.licenses import scan_licenses

    found = scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("detections", lambda d: d["base"])
    starts = F.transform("base", lambda d: d["start"].cast("long"))
    names = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"])))
    both = F.array_sort(F.array_union(names("base"), names("kept")))
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(names("base"), ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"), F.coalesce(F.array_max(F.transform("kept", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import read_records, write_bundles

    folder, index = write_bundles(_table(spark, sf_dir, "pages"))
    return read_records(folder, index, payloads=False).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.packing import best_fit_pack

    return best_fit_pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


def _remainder(mod: int):
    """crc32 of doc_id written as text, modulo ``mod``; of a null doc_id, -1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod, F.lit(-1))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.vector_dedup import link_vectors

    return link_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import score_toxicity

    scored = score_toxicity(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn_from=_remainder(4) != 2, keep=["doc_id"]
    )
    held = (_remainder(4) == 2).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.langid import fit, identify

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, learn_from=_remainder(3) != 1)
    held = (_remainder(3) == 1).alias("held_out")
    return identify(docs, model, keep=["doc_id"]).select("doc_id", held, "lang_pred", "score")


def op11_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.brown import brown_scores

    model, rows = brown_scores(_table(spark, sf_dir, "documents"), learn_from=_remainder(5) != 1, keep=["doc_id"])
    held = (_remainder(5) == 1).alias("held_out")
    return rows.select("doc_id", held, "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.turns import damage, repairs_of

    conversations = _table(spark, sf_dir, "conversations")
    return repairs_of(damage(conversations), ids=conversations)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.whitening import fit_whitening, whitened

    vectors = _table(spark, sf_dir, "embeddings")
    model = fit_whitening(vectors, components=4)
    explained = F.array(*[F.lit(float(e)) for e in model.explained[:4]]) if model.n else F.array(F.lit(0.0))
    rows = whitened(vectors, model, components=4, keep=["vec_id"]).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("place") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_line_dedup": op2_line_dedup,
    "op3_mixing": op3_mixing,
    "op4_neighbours": op4_neighbours,
    "op5_licenses": op5_licenses,
    "op6_warc": op6_warc,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_language": op10_language,
    "op11_brown": op11_brown,
    "op12_turns": op12_turns,
    "op13_whitening": op13_whitening,
    "pipeline": pipeline,
}

__all__ = ["ORACLES", "QUERIES"]
