"""Near-duplicate vectors: an HNSW graph per shard, every shard queried, beams widened until recall audits pass.

Equal vectors form classes first. Classes are dealt to shards by hash; a task builds a shard's graph once and writes it
as rows, and tasks for (shard, block of queries) read it and search it with all vectors. A query's beam is doubled while it is full of vectors over the
threshold, so no number of near neighbours is cut off; and in each task a sample of queries is held against brute
force over the shard: while their recall is below the target, the beams of the whole block are doubled, at last to
the shard's size. Cosines are then computed in double precision, and only pairs that pass count. A task returns
counts and, of its links, one edge for each node to its group's root, so dense groups don't multiply rows; the
components of those edges are found across shards.

Defined cases: vectors that are null, empty, zero, non-finite or of another dimension link with nothing and are kept
as components of their own; copies link with each other and with whatever the others link with; rows that share a
vec_id are vectors of their own; a null vec_id can't be a component's id and is kept only where it stands alone; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.graphs import Hnsw
from tidemark.llm.shared import materialize
from tidemark.llm.vectors import classes, sharded, stack, unit, usable


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges with the smallest node of its group."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, a, b = np.arange(len(nodes)), flat[: len(a)], flat[len(a) :]
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def audited_links(index: Hnsw, queries: np.ndarray, threshold: float, ef: int, audits: int, target: float, slack: float = 1e-4) -> list[np.ndarray]:
    """Candidates of each query over ``threshold``, with beams widened until every audited query reaches ``target``.

    The audited are those of an even sample that have a neighbour besides themselves, each for itself, so that a dense
    group can't speak for a sparse one, and as many made from the shard's own vectors, turned away from them to the
    threshold, so that there is something to find in every shard. A shard whose audit fails with all of it in the beam
    is searched by brute force.
    """
    n, rng = len(index.vectors), np.random.default_rng(11)
    own = index.vectors[np.unique(np.linspace(0, n - 1, min(audits, n)).astype(int))]
    aside = rng.standard_normal(own.shape).astype(np.float32)
    aside -= own * np.einsum("ij,ij->i", aside, own)[:, None]
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-30)
    near = min(1.0, threshold + 1e-3)
    turned = near * own + np.float32(np.sqrt(1 - near * near)) * aside
    picked = queries[np.unique(np.linspace(0, len(queries) - 1, min(audits, len(queries))).astype(int))]
    like = picked @ index.vectors.T
    some = (like >= threshold - slack).sum(axis=1) > (like >= 1 - 1e-6).sum(axis=1)
    asked = np.concatenate([picked[some], turned])
    truth = np.concatenate([like[some], turned @ index.vectors.T]) >= threshold - slack

    def enough() -> bool:
        """All audited of the sample find what they should, and so do ``target`` of the made ones."""
        good = [truth[k, f].sum() >= target * truth[k].sum() for k, f in enumerate(index.within(asked, threshold - slack, ef))]
        return all(good[: some.sum()]) and np.mean(good[some.sum() :]) >= target

    while not enough():
        ef *= 2
        if ef >= 2 * len(index.vectors):
            out = []
            for lo in range(0, len(queries), 256):
                out += [np.flatnonzero(row >= threshold - slack) for row in queries[lo : lo + 256] @ index.vectors.T]
            return out
    return index.within(queries, threshold - slack, ef)


def link_vectors(vectors: DataFrame, threshold: float = 0.9, shard_rows: int = 50_000, shards: int = 6, block_rows: int = 10_000,
                 links: int = 16, ef: int = 64, audits: int = 64, target: float = 0.995) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding)."""
    rows, rest = usable(vectors)
    same = materialize(classes(rows), "vec-classes")
    dealt, shards = sharded(same, shard_rows, shards)

    def build(base: pd.DataFrame) -> pd.DataFrame:
        base = base.sort_values("cid")
        index = Hnsw(unit(stack(base["v"])), links=links, ef=ef)
        return base.assign(pos=np.arange(len(base)), near=index.rows(), top=np.arange(len(base)) == index.top[0])[["shard", "cid", "n", "v", "pos", "near", "top"]]

    schema = "shard int, cid long, n long, v array<double>, pos int, near array<array<int>>, top boolean"
    dealt = materialize(dealt.groupBy("shard").applyInPandas(build, schema), "vec-graphs")
    blocks = max(1, -(-same.count() // block_rows))

    def search(base: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(base) or not len(asked):
            return pd.DataFrame({"cid": [], "n_links": [], "root": []})
        base, asked = base.sort_values("pos"), asked.sort_values("cid")
        own, other = stack(base["v"]), stack(asked["v"])
        index = Hnsw.restored(unit(own), base["near"].tolist(), int(base["pos"].to_numpy()[base["top"].to_numpy()][0]))
        found = audited_links(index, unit(other), threshold, ef, audits, target)
        q = np.repeat(np.arange(len(found)), [len(f) for f in found])
        c = np.concatenate(found) if len(q) else np.zeros(0, dtype=np.int64)
        cos = np.empty(len(q))
        norm_own, norm_other = np.linalg.norm(own, axis=1), np.linalg.norm(other, axis=1)
        for lo in range(0, len(q), 200_000):
            s = slice(lo, lo + 200_000)
            cos[s] = np.einsum("ij,ij->i", other[q[s]], own[c[s]]) / norm_other[q[s]] / norm_own[c[s]]
        ids, keys = base["cid"].to_numpy(), asked["cid"].to_numpy()
        good = (cos >= threshold) & (ids[c] != keys[q])
        q, c = q[good], c[good]
        count = np.bincount(q, weights=base["n"].to_numpy(dtype=float)[c], minlength=len(keys)).astype(np.int64)
        nodes, roots = local_roots(keys[q], ids[c])
        return pd.concat([
            pd.DataFrame({"cid": keys, "n_links": count, "root": keys})[count > 0],
            pd.DataFrame({"cid": nodes, "n_links": 0, "root": roots})[nodes != roots],
        ])

    parts = dealt.withColumn("block", F.explode(F.expr(f"sequence(0, {blocks - 1})")))
    asked = same.withColumn("block", F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.expr(f"sequence(0, {shards - 1})")))
    linked = materialize(
        parts.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(search, "cid long, n_links long, root long"), "vec-links"
    )
    counts = linked.groupBy("cid").agg(F.sum("n_links").alias("n_links"))
    groups = components(linked.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    of_class = same.join(counts, "cid", "left").join(groups, same["cid"] == groups["node"], "left").select(
        "v", F.coalesce("n_links", F.lit(0)).alias("_l"), F.coalesce("root", "cid").alias("_g"), "n"
    )
    placed = materialize(rows.join(of_class, "v").select("vec_id", "uid", (F.col("_l") + F.col("n") - 1).alias("n_links"), F.col("_g")), "vec-placed")
    least = placed.groupBy("_g").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("_size"))
    good = placed.join(least, "_g").select("vec_id", "n_links", "component_id", "_size")
    bad = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(1).cast("long").alias("_size"))
    return good.unionByName(bad).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("_size") == 1).alias("kept")
    )
