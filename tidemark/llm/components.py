"""Connected components by alternating large-star and small-star rounds: edges stay distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` (u, v) written, and what tells two edge sets apart: their number and the sum of their hashes."""
    seen = Observation()
    watched = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    table = materialize(watched, "cc")
    return table, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: comparable ids); root is the smallest node reachable.

    Each round is two grouped minima and two joins back, written to the shared folder; the minima combine before the
    shuffle, so a node with very many neighbours is no hot task. Rounds go on until one changes nothing; that is told
    while the round is written, without a pass of its own. Self-loops are allowed; null ids are dropped.
    """
    own = edges.where("a is not null and b is not null")
    nodes = own.select(F.col("a").alias("node")).union(own.select(F.col("b").alias("node"))).distinct()
    now, mark = _written(own.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while mark[0] and mark != before:
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now, mark = _written(small.select("e.u", "e.v").where("u <> v").distinct())
    root = now.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(root, nodes["node"] == root["u"], "left").select("node", F.coalesce("root", "node").alias("root"))
