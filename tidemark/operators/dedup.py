"""Exact and greedy near-duplicate suppression of documents inside a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import containment, dedup_tokens, digest, token_shingles
from tidemark.lineage import cut


def fingerprints(docs: DataFrame, text: str = "text", width: int = 5) -> DataFrame:
    """``docs`` with tokens, norm, digest, n_tokens and shingles."""
    return (
        docs.withColumn("tokens", dedup_tokens(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("norm", F.array_join("tokens", " "))
        .withColumns({"digest": digest(F.col("norm")), "n_tokens": F.size("tokens"), "shingles": token_shingles(F.col("tokens"), width)})
    )


def exact_groups(docs: DataFrame, key: str = "digest", least: int = 2) -> DataFrame:
    return docs.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where(F.col("copies") >= least)


def near_classes(docs: DataFrame, group: list[str], threshold: float, min_tokens: int = 120, ratio: float = 0.94) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): texts of one group and suffix that are alike. A member is (group, rep, id): ``rep`` is the least id of those with
    the same tokens, itself included. A pair is (group, a, b, similarity) of two representatives, a < b, so copies never meet in pairs.

    Candidates share a shingle of a prefix: with shingles in one global order, rarest first, two sets that have a share t of the
    shorter one's in common share one among the first n - ceil(t*n) + 1 of each. Texts of too different lengths are no
    candidates. Similarity is containment, or Jaccard of all shingles. A text that another contains misses at most the shingles at
    its two ends, the other those of its further tokens: where n-grams repeat, that is less than a share t, and the prefix longer.
    """
    keyed = docs.where(F.col("n_tokens") >= min_tokens).withColumn("_key", F.struct(*group, "suffix"))  # in a struct, null equals null
    # Tokens and shingles are made once; what follows reads the columns it needs.
    keyed = cut(keyed.select("_key", *group, "doc_id", "n_tokens", "digest", "norm", "shingles"), "near-docs")
    heads = keyed.groupBy("_key", "digest").agg(F.min("doc_id").alias("rep"))
    members = cut(keyed.select("_key", "digest", F.col("doc_id").alias("id"), *group).join(heads, ["_key", "digest"]).select("_key", *group, "rep", "id"), "near-members")
    copies = members.where("rep <> id").select(F.col("id").alias("doc_id"))
    big = without(keyed, copies).select("_key", F.col("doc_id").alias("id"), "n_tokens", "norm", "shingles")
    # A shingle of one group is one number; numbers that agree by chance only add candidates, and groups are compared below.
    each = big.select("id", "n_tokens", F.size("shingles").alias("_n"), F.explode("shingles").alias("g"), "_key").select("id", "n_tokens", "_n", F.xxhash64("_key", "g").alias("g"))
    shared = each.withColumn("_df", F.count(F.lit(1)).over(Window.partitionBy("g"))).where("_df > 1")
    own = Window.partitionBy("id")
    # Shingles that no other text has come first; they only count.
    first = shared.withColumns({"_r": F.row_number().over(own.orderBy("_df", "g")), "_shared": F.count(F.lit(1)).over(own)})
    within = F.col("_n") - F.floor(F.col("n_tokens") * F.lit(1 - ratio) + 1e-9) - 2
    reach = F.col("_n") - F.greatest(F.lit(1), F.least(F.ceil(F.col("_n") * F.lit(threshold) - 1e-9), within)) + 1
    prefix = cut(first.where(F.col("_r") + F.col("_n") - F.col("_shared") <= reach).select("g", "id", "n_tokens"), "near-prefixes")
    left, right = (prefix.select("g", F.col("id").alias(x), F.col("n_tokens").alias(f"n{x}")) for x in "ab")
    met = left.join(right, "g").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= ratio * F.greatest("na", "nb"))).select("a", "b").distinct()
    pairs = cut(met, "near-candidates")
    # Only texts that have a candidate travel.
    asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = among(big.select("_key", "id", "norm", "shingles"), asked)
    one, two = (texts.select(F.col("id").alias(x), F.col("_key").alias(f"k{x}"), F.col("norm").alias(f"x{x}"), F.col("shingles").alias(f"s{x}")) for x in "ab")
    full = pairs.join(one, "a").join(two, "b").where(F.col("ka").eqNullSafe(F.col("kb")))
    both = F.size(F.array_intersect("sa", "sb"))
    sim = F.greatest(containment(F.col("xa"), F.col("xb")), F.coalesce(both / (F.size("sa") + F.size("sb") - both), F.lit(0.0)))
    found = full.withColumn("similarity", sim).where(F.col("similarity") >= threshold)
    return cut(found.select(*[F.col(f"ka.{c}").alias(c) for c in group], "a", "b", "similarity"), "near-pairs"), members.drop("_key")


def among(rows: DataFrame, keys: DataFrame, most: int = 2_000_000) -> DataFrame:
    """The ``rows`` whose key is one of ``keys`` (one column): a list of at most ``most`` goes to the rows, beyond, both are shuffled."""
    keys = cut(keys, "near-keys")
    return rows.join(F.broadcast(keys) if keys.count() <= most else keys, keys.columns, "left_semi")


def without(rows: DataFrame, keys: DataFrame, most: int = 2_000_000) -> DataFrame:
    """The ``rows`` whose key is none of ``keys``, as ``among``."""
    keys = cut(keys, "near-keys")
    return rows.join(F.broadcast(keys) if keys.count() <= most else keys, keys.columns, "left_anti")


#: Documents of one text that meet others at once.
BLOCK = 1_000


def near_pairs(docs: DataFrame, group: list[str], threshold: float, min_tokens: int = 120, ratio: float = 0.94, only: DataFrame | None = None) -> DataFrame:
    """(group, a, b, similarity) of all alike documents, a < b, copies included (of documents that ``only``, doc_id, names).

    Their number grows with the square of the copies, so a text's copies are dealt over blocks: no task has more than the pairs
    of two blocks under one key."""
    pairs, members = near_classes(docs, group, threshold, min_tokens, ratio)
    members = members.select("rep", "id", *group)
    if only is not None:
        members = members.join(only.select(F.col("doc_id").alias("id")), "id", "left_semi")
    counts = members.groupBy("rep").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in group])
    sizes = cut(counts.select("rep", "_n", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"), *group), "near-sizes")
    dealt = cut(members.select("rep", "id").join(sizes.select("rep", "_blocks"), "rep").select("rep", F.pmod(F.xxhash64("id"), "_blocks").cast("int").alias("_k"), "id"), "near-dealt")
    of = lambda x: sizes.select(F.col("rep").alias(f"_{x}"), F.col("_blocks").alias(f"_blocks_{x}"))
    alike = pairs.withColumnsRenamed({"a": "_a", "b": "_b"}).join(of("a"), "_a").join(of("b"), "_b")
    same = sizes.where("_n > 1").select(*group, F.col("rep").alias("_a"), F.col("rep").alias("_b"), F.lit(1.0).alias("similarity"), F.col("_blocks").alias("_blocks_a"), F.col("_blocks").alias("_blocks_b"))
    every = lambda x: F.explode(F.sequence(F.lit(0), F.col(f"_blocks_{x}") - 1)).alias(f"_k{x}")
    met = alike.unionByName(same).select("*", every("a")).select("*", every("b")).where("_a <> _b or _ka <= _kb")
    keys = ["_a", "_ka", "_b", "_kb"]
    one, two = (dealt.select(F.col("rep").alias(f"_{x}"), F.col("_k").alias(f"_k{x}"), F.col("id").alias(x)) for x in "ab")
    left, right = met.select(*keys, *group, "similarity").join(one, ["_a", "_ka"]), met.select(*keys).join(two, ["_b", "_kb"])
    found = left.join(right, keys).where("_a <> _b or _ka <> _kb or a < b")
    return found.select(*group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def one_per_class(docs: DataFrame, group: list[str], order: list[Column], min_tokens: int) -> DataFrame:
    """``docs`` with ``head``, the best-ranked document of the class that meets every other document alike.

    Long texts of one suffix and digest are a class, unless their file hash also occurs with another suffix or digest;
    then the hash counts too. Short texts are a class by hash, and alone without one. So copies never meet in pairs.
    """
    files = docs.where("file_hash is not null").groupBy(*group, "file_hash").agg(F.min(F.struct("suffix", "digest")).alias("_lo"), F.max(F.struct("suffix", "digest")).alias("_hi"))
    wide = files.where("_lo <> _hi").select(*group, "file_hash", F.lit(True).alias("_wide"))
    long = F.col("n_tokens") >= min_tokens
    by_hash = F.when(F.col("file_hash").isNotNull() & (F.coalesce("_wide", F.lit(False)) | ~long), F.concat(F.lit("h"), "file_hash"))
    marked = docs.join(wide, [*group, "file_hash"], "left").withColumn(
        "_class", F.coalesce(by_hash, F.when(~long, F.concat(F.lit("d"), F.col("doc_id").cast("string"))), F.lit("t")))
    marked = marked.withColumn("_key", F.struct(*group, "suffix", "digest", "_class"))  # in a struct, null equals null
    heads = marked.groupBy("_key").agg(F.min_by("doc_id", F.struct(*order)).alias("head"))
    return marked.join(heads, "_key").drop("_key", "_class", "_wide")


def same_file(docs: DataFrame, group: list[str]) -> DataFrame:
    """(group, a, b): documents with one file hash, whatever their suffix and length."""
    each = docs.where("file_hash is not null").select(*group, "file_hash", "doc_id")
    return each.withColumnRenamed("doc_id", "a").join(each.withColumnRenamed("doc_id", "b"), [*group, "file_hash"]).where("a < b").select(*group, "a", "b")


def suppress(docs: DataFrame, group: list[str], threshold: float, order: list[Column], min_tokens: int = 120) -> DataFrame:
    """doc_id, keep, duplicate_of for ``docs`` (doc_id, file_hash, suffix, fingerprints): in rank order, each is dropped that has
    the file hash of a kept one, or its suffix and at least ``threshold`` of its text. A null hash equals none."""
    # Texts and shingles are read once, by the search for pairs; classes need none of them.
    marked = cut(one_per_class(docs.drop("text", "tokens", "norm", "shingles"), group, order, min_tokens), "dedup-classes")
    heads = marked.where("doc_id = head")
    pairs = near_pairs(docs, group, threshold, min_tokens, only=heads).select(*group, "a", "b").unionByName(same_file(heads, group)).distinct()
    state = greedy_keep(heads, pairs, group, order).select(F.col("doc_id").alias("head"), F.col("keep").alias("_keep"), F.col("duplicate_of").alias("_of"))
    is_head = F.col("doc_id") == F.col("head")
    return marked.select("doc_id", "head").join(state, "head").select(
        "doc_id", (is_head & F.col("_keep")).alias("keep"), F.coalesce("_of", F.when(~is_head, F.col("head"))).alias("duplicate_of"))


def greedy_keep(docs: DataFrame, pairs: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """doc_id, keep, duplicate_of: documents in ``order`` (ascending, no ties), each dropped if it matches one that is kept.

    A document is decided once all its better-ranked matches are: kept if none of them is kept, dropped as soon as one
    is. Every round decides at least the best undecided one of each cluster, all clusters at once. Ranks are compared
    pair by pair, so no group is sorted.
    """
    ranked = docs.select(*group, F.col("doc_id").alias("id"), F.struct(*order).alias("rk"))
    a, b = ranked.select(F.col("id").alias("a"), F.col("rk").alias("ra")), ranked.select(F.col("id").alias("b"), F.col("rk").alias("rb"))
    edges = pairs.select("a", "b").join(a, "a").join(b, "b").select(
        F.when(F.col("ra") < F.col("rb"), F.col("a")).otherwise(F.col("b")).alias("better"), F.when(F.col("ra") < F.col("rb"), F.col("ra")).otherwise(F.col("rb")).alias("brk"),
        F.when(F.col("ra") < F.col("rb"), F.col("b")).otherwise(F.col("a")).alias("worse"),
    )
    edges = cut(edges, "greedy-edges")
    involved = edges.select(F.col("better").alias("id")).union(edges.select("worse")).distinct()
    state = involved.withColumn("keep", F.lit(None).cast("boolean"))
    while True:
        seen = edges.join(state.select(F.col("id").alias("better"), F.col("keep").alias("_k")), "better").groupBy(F.col("worse").alias("id")).agg(
            F.bool_or(F.coalesce("_k", F.lit(False))).alias("_hit"), F.bool_or(F.col("_k").isNull()).alias("_wait")
        )
        new = F.coalesce("keep", F.when(F.col("_hit"), F.lit(False)).when(~F.coalesce("_wait", F.lit(False)), F.lit(True)))
        state = cut(state.join(seen, "id", "left").select("id", new.alias("keep")), "greedy-state")
        if state.where("keep is null").isEmpty():
            break
    kept = state.where("keep").select(F.col("id").alias("better"))
    of = edges.join(kept, "better").groupBy(F.col("worse").alias("id")).agg(F.min_by("better", "brk").alias("duplicate_of"))
    return ranked.join(state, "id", "left").join(of, "id", "left").select(
        F.col("id").alias("doc_id"), F.coalesce("keep", F.lit(True)).alias("keep"), F.when(~F.coalesce("keep", F.lit(True)), F.col("duplicate_of")).alias("duplicate_of")
    )
