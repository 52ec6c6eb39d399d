"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are put in a keyed random order and cut into blocks of about ``block_words`` words. The target of
a source becomes an exact quota of block draws: whole passes over its blocks, then a part of one pass. The vector of
quotas of all sources is split over the output shards by a binary tree: each node deals half of its draws to the left
child by one multivariate hypergeometric draw, which is what a uniform random deal would give, without listing the
draws. A shard then owns a range of draw numbers of every source; an affine permutation of a pass's blocks turns them
into disjoint blocks, and the shard shuffles its documents locally.

Only per-source totals (a row for each source) and the top of the tree (512 nodes) are on the driver; documents stay
distributed, and a source with a third of all rows is spread over as many tasks as its size asks for, because its
order is cut into buckets by the leading part of the hash and only bucket totals are prefix-summed.

Defined cases: null text has no words; a null source is a source of its own, last in order; documents without words
are never taken; rows alike in doc_id, text and source are taken together; an empty table mixes to an
empty table; other columns are carried along, but for those named as the columns made here, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize

WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of maximal runs of anything but ASCII white space."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    squeezed = F.trim(F.regexp_replace(flat, " +", " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(
        F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "))) + 1
    ).cast("long")


def targets(sizes: dict, weights: dict, cap: float = 3.0) -> dict:
    """Shares of the sum of all sizes by weight; a share stops at cap x size and the excess is reshared by weight."""
    fixed: dict = {}
    total = float(sum(sizes.values()))
    while True:
        free = [s for s in sizes if s not in fixed]
        weight = sum(weights[s] for s in free)
        left = total - sum(fixed.values())
        share = {s: left * weights[s] / weight for s in free} if weight else {}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def subtrees(lo: int, hi: int, left: np.ndarray, seed: int, most: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """The nodes of at most ``most`` shards below (lo, hi), in order, each with its draws of each source."""
    todo = [(lo, hi, np.asarray(left, dtype=np.int64))]
    while todo:
        lo, hi, left = todo.pop()
        if hi - lo <= most:
            yield lo, hi, left
            continue
        mid, rng = (lo + hi) // 2, np.random.default_rng([seed, lo, hi])
        rest, need = int(left.sum()), int(left.sum()) * (mid - lo) // (hi - lo)
        part = np.zeros_like(left)
        for k, have in enumerate(left.tolist()):  # one hypergeometric draw a source: valid for any totals
            rest -= have
            part[k] = have if need >= rest + have else (rng.hypergeometric(have, rest, need) if have and need else 0)
            need -= int(part[k])
        todo += [(mid, hi, left - part), (lo, mid, part)]


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Draws of each source for each shard (shards x sources); columns sum to the quotas exactly."""
    return np.stack([left for _, _, left in subtrees(0, shards, np.asarray(quotas), seed, 1)])


def shard_ranges(rows: Iterable[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    """Each shard's range of draw numbers of every source it draws from, below the given nodes."""
    for pdf in rows:
        for lo, hi, left, first in pdf.itertuples(index=False):
            at, out = np.array(first, dtype=np.int64), []
            for shard, _, draws in subtrees(int(lo), int(hi), np.array(left), seed, 1):
                some = np.flatnonzero(draws)
                out.append(pd.DataFrame({"_sid": some, "shard": shard, "lo": at[some], "hi": (at + draws)[some]}))
                at = at + draws
            yield pd.concat(out)


def _fill_last_block(sizes: list[int], room: int) -> list[bool]:
    """Whole documents, largest first, that fit into what is left of a quota at its end."""
    taken = [False] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if 0 < sizes[i] <= room:
            taken[i], room = True, room - sizes[i]
    return taken


def mix_sources(
    docs: DataFrame, weights: dict | None = None, block_words: int = 65_536, shard_words: int = 2_000_000,
    cap: float = 3.0, seed: int = 17, keep: list[str] | None = None,
) -> DataFrame:
    """Rows of ``docs`` (its columns in ``keep``, by default all) with size, source_size, target, takes and draws.

    ``weights`` maps a source (None for null) to its weight; by default 1, 2, 3 repeat by code point, null last.
    ``docs`` needs doc_id, text and source. A document is taken whole, ``takes`` (0 to cap) times; ``draws`` is an
    array of (pass, shard, place) with one entry for each time, and sorting a shard's entries by ``place`` is its
    local shuffle. Rows alike in doc_id, text and source are taken together.
    """
    spark = docs.sparkSession
    mark = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text"))
    units = materialize(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("_one"), mark.alias("_h"))
        .groupBy("doc_id", "source", "_h", "_one").agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_words", F.col("_one") * F.col("_copies")),
        "mix-units",
    )
    totals = units.groupBy("source").agg(F.sum("_words").alias("words"), F.count(F.lit(1)).alias("rows"), F.max("_words").alias("longest")).collect()
    found = sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = {r["source"]: int(r["words"]) for r in found}
    weights = weights or {s: 1 + k % 3 for k, s in enumerate(sizes)}
    target = targets(sizes, weights, cap)

    facts, quotas, turns = [], [], []
    rng = np.random.default_rng([seed, 1])
    for k, r in enumerate(found):
        words, goal = sizes[r["source"]], target[r["source"]]
        passes = min(int(goal // words), int(cap)) if words else 0
        rest = int(round(goal - passes * words)) if words else 0
        if words and rest >= words:
            passes, rest = passes + 1, 0
        n_blocks = max(1, -(-words // block_words))
        # The part pass ends in block rest // block_words; what it lacks there may come from as far as the longest document reaches.
        last = min(n_blocks - 1, rest // block_words + 1 + int(r["longest"] or 0) // block_words)
        facts.append((k, r["source"], words, float(goal), passes, rest, last, max(1, int(r["rows"]) // 2_000)))
        quotas.append(passes * n_blocks + (last + 1 if rest else 0))
        for p in range(passes + bool(rest)):
            n = n_blocks if p < passes else last + 1
            a = int(rng.integers(1, n + 1))
            while gcd(a, n) != 1:
                a = a % n + 1
            turns.append((k, p, n, a, int(rng.integers(0, n)), p * n_blocks))
    sources = spark.createDataFrame(
        facts, "_sid int, _src string, source_size long, target double, _passes int, _rest long, _last long, _buckets int"
    )
    shards = max(1, round(sum(sizes.values()) / shard_words))
    # The top of the tree is dealt here, at most 512 nodes of it; the shards below them where those nodes lie.
    tops, at = [], np.zeros(len(quotas), dtype=np.int64)
    for lo, hi, left in subtrees(0, shards, np.array(quotas, dtype=np.int64), seed, -(-shards // 256)):
        tops.append((lo, hi, left.tolist(), at.tolist()))
        at = at + left
    # One row a source: broadcast only where they are few.
    small = F.broadcast if len(found) <= 100_000 else (lambda rows: rows)
    keyed = units.join(small(sources), F.col("source").eqNullSafe(F.col("_src"))).drop("_src").withColumn(
        "_bucket", F.floor((F.shiftright("_h", 32) + 2.0**31) / 2.0**32 * F.col("_buckets")).cast("int")
    )
    # Where each bucket begins in its source: a prefix sum over bucket totals, then a window inside the bucket alone.
    before = Window.partitionBy("_sid").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin = keyed.groupBy("_sid", "_bucket").agg(F.sum("_words").alias("_w")).select(
        "_sid", "_bucket", (F.sum("_w").over(before) - F.col("_w")).alias("_begin")
    )
    inside = Window.partitionBy("_sid", "_bucket").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = materialize(
        keyed.join(begin, ["_sid", "_bucket"])
        .withColumn("_at", F.col("_begin") + F.sum("_words").over(inside) - F.col("_words"))
        .withColumn("_block", F.expr(f"_at div {block_words}"))
        .withColumn("_part", F.expr("_rest > 0 and _at + _words <= _rest and _words > 0"))
        .drop("_bucket", "_buckets", "_begin"),
        "mix-placed",
    )

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at", kind="stable")
        return pdf.assign(_fits=_fill_last_block(pdf["_words"].tolist(), int(pdf["_room"].iloc[0])))[["_sid", "_at", "_fits"]]

    whole = placed.where("_part").groupBy("_sid").agg(F.sum("_words").alias("_got"))
    edge = placed.where("_rest > 0 and not _part and _block <= _last and _words > 0").join(small(whole), "_sid", "left")
    # Each of these documents has a word or more: two blocks and the longest document bound their number.
    fits = (
        edge.select("_sid", "_at", "_words", (F.col("_rest") - F.coalesce("_got", F.lit(0))).alias("_room"))
        .groupBy("_sid").applyInPandas(fill, "_sid int, _at long, _fits boolean").where("_fits")
    )
    nodes = spark.createDataFrame(tops, "lo int, hi int, draws array<long>, first array<long>").repartition(max(1, len(tops) // 16))
    ranges = nodes.mapInPandas(lambda rows: shard_ranges(rows, seed), "_sid int, shard int, lo long, hi long")
    draw = ranges.select(
        "_sid", "shard", F.explode(F.expr("sequence(lo, hi - 1)")).alias("draw")
    )
    turn = spark.createDataFrame(turns, "_sid int, pass int, n long, a long, b long, first long")
    blocks = (
        draw.join(small(turn), "_sid")
        .where("draw >= first and draw < first + n")
        .withColumn("_block", F.expr("cast((cast(draw - first as decimal(18,0)) * cast(a as decimal(18,0)) + b) % n as long)"))
        .groupBy("_sid", "_block")
        .agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("_all"))
    )
    none = F.array().cast("array<struct<pass:int,shard:int>>")
    drawn = (
        placed.join(fits, ["_sid", "_at"], "left")
        .withColumn("_part", F.col("_part") | (F.coalesce("_fits", F.lit(False)) & (F.col("_words") > 0)))
        .join(blocks, ["_sid", "_block"], "left")
        .withColumn("_all", F.when(F.col("_words") > 0, F.coalesce("_all", none)).otherwise(none))
        .withColumn("_all", F.filter("_all", lambda d: (d["pass"] < F.col("_passes")) | F.col("_part")))
        .withColumn("draws", F.transform("_all", lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.xxhash64(F.col("_h"), d["pass"]).alias("place"))))
        .withColumn("takes", F.size("draws"))
        .withColumnRenamed("_one", "size")
    )
    made = ["size", "source_size", "target", "takes", "draws"]
    keep = docs.columns if keep is None else keep
    if set(keep) <= {"doc_id", "source"}:
        return drawn.withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)"))).select(*keep, *made)
    plan = drawn.select(F.col("_h").alias("_mark"), F.col("doc_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in made])
    # The row as one column: whatever its columns are called, they clash with none of these.
    whole = F.struct(*[F.col(c) for c in keep if c not in made])
    rows = docs.select(whole.alias("_row"), F.col("doc_id").alias("_doc"), mark.alias("_key"))
    joined = rows.join(plan, (F.col("_key") == F.col("_mark")) & F.col("_doc").eqNullSafe(F.col("_id")))
    return joined.select(F.struct("_row.*", *[F.col(f"_{c}").alias(c) for c in made]).alias("_out")).select("_out.*")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each draw, with pass, shard and place beside the columns of ``docs``."""
    own = [c for c in docs.columns if c not in ("pass", "shard", "place")]
    drawn = mix_sources(docs, **options)
    return drawn.select(F.struct(*own).alias("_row"), F.explode("draws").alias("_draw")).select(F.struct("_row.*", "_draw.pass", "_draw.shard", "_draw.place").alias("_out")).select("_out.*")
