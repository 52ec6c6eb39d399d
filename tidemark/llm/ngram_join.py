"""N-gram Jaccard join: a MinHash LSH forest for candidates, exact verification for links.

Texts alike word by word form classes. Each class has ``trees`` labels, each a string of ``deepest`` MinHash values;
sorted, a tree's labels are a prefix trie, and two classes meet in a tree down to the length of their common prefix.
Matching begins at the full labels. Of all the pairs that meet, the similarity is read off all their values, and while the forest would miss more than 1 - ``target`` of pairs like the least similar ones at the
threshold or above (it finds a pair of similarity s with 1 - (1 - s**depth)**trees), the matched prefixes are shortened by a
value and all classes meet again. So a corpus of plain copies is matched deep, one with borderline pairs as shallow as
it takes; where nothing meets, pairs at the threshold itself are reckoned with. A node adds
one edge for each class, to the first in its sorted order, so a large group of near copies costs edges in proportion to
its members. Components of those edges are closed worlds: all links lie inside one. Inside them every pair is verified
exactly, from the whole texts' shingle sets, by counting common shingles over an inverted index; a component too large
for one task is cut into blocks, and each pair of blocks is a task. Tasks return counts of links and one edge for each
class to its group's root, never pairs.

Broadcasts: only the list of needed texts (16 bytes each), if it has at most ``broadcast_rows``; beyond, a shuffle join.

Defined cases: null and empty texts, and texts without words, link with nothing and are kept; a text of one to four
words has one shingle, all of them; copies link with each other; a null doc_id is the class id only where a class has
no other; of rows that repeat the smallest doc_id of a class one is kept; an empty table gives an empty result; extra
columns are ignored by the join and carried by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import materialize
from tidemark.llm.textcore import mix, powers, shingles, slices, word_hashes
from tidemark.llm.vector_dedup import local_roots

SEED = 20_011


def met_at(classes: DataFrame, depth: int, trees: int, deepest: int) -> DataFrame:
    """a and b, the first of its node, of every class that shares a node of a trie at ``depth`` with another."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    nodes = classes.select("a", "label", tree.alias("tree")).select(
        "a", F.concat(F.substring(F.col("label"), F.col("tree") * (2 * deepest) + 1, F.lit(2 * depth)), F.encode(F.col("tree").cast("string"), "utf-8")).alias("prefix")
    )
    firsts = nodes.groupBy("prefix").agg(F.min("a").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return nodes.join(firsts, "prefix").where("a <> first").select("a", F.col("first").alias("b")).distinct()


def least_alike(edges: DataFrame, classes: DataFrame, threshold: float) -> float:
    """The smallest similarity at ``threshold`` or above, by their labels, of all the edges."""

    def alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(len(batch), -1) for c in ("one", "two"))
                like = (one == two).mean(axis=1)
                yield pa.record_batch([pa.array([like[like >= threshold].min(initial=1.0)])], names=["s"])

    label = lambda key, name: classes.select(F.col("a").alias(key), F.col("label").alias(name))
    both = edges.join(label("a", "one"), "a").join(label("b", "two"), "b").select("one", "two")
    return max(threshold, both.mapInArrow(alike, "s double").agg(F.min("s")).first()[0] or threshold)


def forest_edges(classes: DataFrame, threshold: float, trees: int, deepest: int, target: float) -> DataFrame:
    """The edges of the forest at the greatest depth that finds pairs like the least similar ones with ``target``."""
    depth = deepest
    while True:
        edges = materialize(met_at(classes, depth, trees, deepest), "ngram-edges")
        least = threshold
        if depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
            least = least_alike(edges, classes, threshold)
        if depth == 1 or 1 - (1 - least**depth) ** trees >= target:
            return edges
        depth -= 1


def minhash(grams: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """texts x count MinHash values of 16 bits; every text given here has a shingle."""
    rng = np.random.default_rng(SEED)
    flips, odds = rng.integers(0, 2**32, count, dtype=np.uint32), rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    low = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, count), dtype=np.uint16)
    step = max(1, 400_000 * (len(bounds) - 1) // max(len(low), 1))
    for lo in range(0, len(bounds) - 1, step):  # few enough shingles at a time to stay in the cache
        edges = bounds[lo : lo + step + 1]
        part, cuts = low[edges[0] : edges[-1]], edges[:-1] - edges[0]
        for k in range(count):
            least = np.minimum.reduceat((part ^ flips[k]) * odds[k], cuts)
            out[lo : lo + len(cuts), k] = (least * np.uint32(0x85EBCA6B)) >> np.uint32(16)
    return out


def sequence_hashes(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's sequence of words."""
    up, down = powers(len(words) + 1)
    both = []
    for w in (words, mix(words ^ np.uint64(0x94D049BB133111EB))):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up[: len(w)], dtype=np.uint64)])
        both.append(mix((total[bounds[1:]] - total[bounds[:-1]]) * down[bounds[:-1]] + np.diff(bounds).astype(np.uint64)))
    return both[0], both[1]


def signatures(docs: DataFrame, width: int, trees: int, deepest: int) -> DataFrame:
    """doc_id, mark and mark2 (hashes of the text), a, b (of its words), words and label (all trees' labels, concatenated)."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                words, bounds = word_hashes(part.column("text"))
                a, b = sequence_hashes(words, bounds)
                grams, edges = shingles(words, bounds, width)
                some = np.flatnonzero(np.diff(edges))
                labels = np.full(len(part), None, dtype=object)
                if len(some):
                    rows = minhash(grams, np.append(edges[some], edges[-1]), trees * deepest).byteswap()
                    labels[some] = [r.tobytes() for r in rows]
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("mark"), part.column("mark2"), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.diff(bounds).astype(np.int64)), pa.array(labels, pa.binary())],
                    names=["doc_id", "mark", "mark2", "a", "b", "words", "label"],
                )

    source = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"), F.xxhash64(F.lit(1), "text").alias("mark2"))
    return source.mapInArrow(sign, "doc_id long, mark long, mark2 long, a long, b long, words long, label binary")


def common_counts(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set in turn, how many elements it shares with every set."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    grams, posting = flat[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    count = np.diff(np.append(begin, len(grams)))
    which = np.empty(len(flat), dtype=np.int64)
    which[order] = np.repeat(np.arange(len(begin)), count)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for k in range(len(sets)):
        mine = which[at[k] : at[k + 1]]
        mine = mine[count[mine] > 1]
        n = count[mine]
        upto = np.cumsum(n)
        got = posting[np.repeat(begin[mine] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
        yield k, np.bincount(got, minlength=len(sets))


def verified(keys: np.ndarray, copies: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], threshold: float):
    """(links, root) of each key: counted between sides if there are two, else between all."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    cross = sides.min() != sides.max()
    links, left, right = np.zeros(len(keys), dtype=np.int64), [], []
    for k, common in common_counts(sets):
        good = common >= threshold * (sizes + sizes[k] - common) - 1e-9
        good &= common > 0
        good[k] = False
        if cross:
            good &= sides != sides[k]
        near = np.flatnonzero(good)
        links[k] = copies[near].sum()
        if len(near):
            left.append(np.full(len(near), keys[k]))
            right.append(keys[near])
    roots = dict(zip(*(x.tolist() for x in local_roots(np.concatenate(left), np.concatenate(right))), strict=True)) if left else {}
    return links, np.array([roots.get(k, k) for k in keys.tolist()], dtype=np.int64)


def ngram_join(docs: DataFrame, threshold: float = 0.8, width: int = 5, trees: int = 24, deepest: int = 8, target: float = 0.999,
               task_words: int = 1_500_000, task_texts: int = 3_000, broadcast_rows: int = 2_000_000) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, mark, class_id, n_links, copies and lead.

    ``n_links`` counts the other rows at the threshold or above; ``class_id`` is the smallest doc_id reachable by links;
    ``copies`` counts the rows with the same words; ``mark`` is xxhash64 of the text; ``lead`` marks the rows that may
    stand for their class (those with its smallest doc_id and, of these, the smallest mark).
    """
    signed = materialize(signatures(docs, width, trees, deepest), "ngram-signed")
    rows = signed.drop("label", "mark2")
    own = signed.where("words > 0").groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("mark", "mark2")).alias("_m"), F.max("words").alias("words"), F.max("label").alias("label")
    )
    classes = materialize(own.select("a", "b", "copies", "_m.mark", "_m.mark2", "words", "label"), "ngram-classes")
    edges = forest_edges(classes, threshold, trees, deepest, target)
    worlds = components(edges)
    members = materialize(classes.drop("label", "b").join(worlds.withColumnRenamed("node", "_node"), F.col("a") == F.col("_node")).drop("_node"), "ngram-members")
    sizes = materialize(members.groupBy("root").agg(F.sum("words").alias("_w"), F.count(F.lit(1)).alias("_m")).select(
        "root", F.greatest(F.ceil(F.col("_w") / task_words), F.ceil(F.col("_m") / task_texts)).cast("int").alias("parts"), "_w", "_m"
    ), "ngram-sizes")
    # Each member stands in ``parts`` pairs of blocks: bins by what is dealt, not by what there is.
    total = sizes.agg(F.sum(F.col("_w") * F.col("parts")), F.sum(F.col("_m") * F.col("parts")), F.sum("_m")).first()
    bins = max(1, (total[0] or 0) // task_words, (total[1] or 0) // task_texts)
    sizes = sizes.select("root", "parts")
    needed = members.join(sizes, "root")
    wanted = needed.select(F.col("mark").alias("_mark"), F.col("mark2").alias("_mark2")).distinct()
    if (total[2] or 0) <= broadcast_rows:
        wanted = F.broadcast(wanted)
    both = ["_mark", "_mark2"]
    texts = docs.select("text", F.xxhash64("text").alias("_mark"), F.xxhash64(F.lit(1), "text").alias("_mark2")).join(wanted, both, "left_semi")
    # Copies collapse inside each task before the shuffle.
    one = texts.groupBy(*both).agg(F.first("text").alias("text"))

    def to_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                grams, edges = shingles(*word_hashes(part.column("text")), width)
                sets = [np.unique(grams[s:e]).view(np.int64) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.record_batch([*map(part.column, both), pa.array(sets, pa.list_(pa.int64()))], names=[*both, "grams"])

    filled = one.mapInArrow(to_sets, "_mark long, _mark2 long, grams array<long>").join(needed, (F.col("_mark") == F.col("mark")) & (F.col("_mark2") == F.col("mark2"))).drop(*both)
    side = F.pmod(F.xxhash64("a", F.lit(3)), F.col("parts")).cast("int")
    dealt = filled.withColumn("side", side).withColumn("_other", F.explode(F.expr("sequence(0, parts - 1)"))).select(
        "root", "a", "copies", "grams", "side", "parts", F.least("side", "_other").alias("lo"), F.greatest("side", "_other").alias("hi")
    ).withColumn("bin", F.pmod(F.xxhash64("root", "lo", "hi"), F.lit(bins)).cast("int"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["root", "lo", "hi", "a"], kind="stable").reset_index(drop=True)
        where = pdf[["root", "lo", "hi"]].to_numpy()
        cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
        out = []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            part = pdf.iloc[s:e]
            keys = part["a"].to_numpy()
            sides = part["side"].to_numpy()
            if where[s, 1] != where[s, 2] and sides.min() == sides.max():
                continue  # the other block is empty
            links, roots = verified(keys, part["copies"].to_numpy(), sides, [np.asarray(g) for g in part["grams"]], threshold)
            some = links > 0
            out.append(pd.DataFrame({"a": keys[some], "n_links": links[some], "group": roots[some], "parts": part["parts"].to_numpy()[some]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "n_links": [], "group": [], "parts": []})

    linked = materialize(dealt.groupBy("bin").applyInPandas(verify, "a long, n_links long, group long, parts int"), "ngram-linked")
    counts = linked.groupBy("a").agg(F.sum("n_links").alias("n_links"), F.min("group").alias("group"), F.max("parts").alias("parts"))
    # Only components that were cut into blocks have links of one group in several tasks.
    cut = components(linked.where("parts > 1").select("a", F.col("group").alias("b")))
    groups = counts.join(cut, counts["a"] == cut["node"], "left").select(counts["a"].alias("_a"), "n_links", F.coalesce("root", "group").alias("group"))
    of_class = classes.select("a", "b", "copies").join(groups, F.col("a") == F.col("_a"), "left").select(
        "a", "b", "copies", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("group", "a").alias("group")
    )
    placed = materialize(
        rows.where("words > 0").join(of_class, ["a", "b"]).select("doc_id", "mark", "copies", "n_links", "group"), "ngram-placed"
    )
    heads = placed.groupBy("group").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("k"), "mark")).alias("_h"), F.min("doc_id").alias("class_id"))
    named = placed.join(heads, "group").select(
        "doc_id", "mark", "class_id", "n_links", "copies",
        ((F.coalesce("doc_id", F.lit(2**63 - 1)) == F.col("_h.k")) & (F.col("mark") == F.col("_h.mark"))).alias("lead"),
    )
    wordless = rows.where("words = 0").select(
        "doc_id", "mark", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("copies"), F.lit(True).alias("lead")
    )
    return named.unionByName(wordless)


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, all without words."""
    joined = ngram_join(docs, **options)
    lead = joined.where("lead").groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.max("copies").alias("_n"), F.max("n_links").alias("_l"))
    # The row as one column: whatever its columns are called, they clash with none of these.
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_m"))
    rows = whole.join(lead, (F.col("_d").eqNullSafe(F.col("_id"))) & (F.col("_m") == F.col("_mark")))
    # Rows alike in doc_id and text can only be repeats where a class has copies.
    alone = rows.where("_n = 1 or _l = 0").select("_row.*")
    repeated = rows.where("not (_n = 1 or _l = 0)").dropDuplicates(["_d", "_m"]).select("_row.*")
    return alone.unionByName(repeated)
