"""Toxicity by class-conditional Kneser-Ney bigram models with shared backoff.

Counts of word bigrams are gathered from every labelled training document, by class, with a sum inside each batch
before the shuffle. A class's bigram model discounts its own counts and backs off to the discounted pooled counts of
both classes, then to its own unigram model, and that one to continuation counts (in how many different contexts a word
stands) which both classes share. So a bigram that a class has not met takes the pooled probability, and a rare one
tells the classes apart as far as its counts do: every word and bigram is scored, none is selected. A text's
log-likelihood ratio is the sum over all its words of the logarithms of the two models' quotient. It is summed in two
parts, since a few well-attested expressions drown in what very many rare ones add up to: the part of expressions whose
likelihood-ratio statistic G2 of the count split passes ``evidence``, and the part of all others. The score is a
logistic function of both, each by word (length-normalised) and in total. It is fitted on training documents by
expressions counted without them, since a document's own counts would speak for its label.

Workers map the expressions' tables from the shared folder if they have at most ``table_rows`` rows, so that a machine holds
them once; beyond that a text's expressions are joined with them in a shuffle and summed, with the same result. Counting and
scoring read whole texts.

Defined cases: null and empty texts have no words and get the prior's score; labels that are null are no labels; of
several labels of a doc_id the largest counts; a null doc_id has no label and is not held out; with one class only,
the score is that class's share; equal rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.lookup import Lookup, close_mapped, drop_folder, write_lookup
from tidemark.llm.shared import bounded_batches, materialize, private
from tidemark.llm.textcore import give_back, slices, word_hashes

START = np.uint64(0x51ED270B7A1C4E95)
#: A bigram is one number: half of the hash of its second word, then half of that of its first.
HEAD_BITS = 32


def tails(words: np.ndarray) -> np.ndarray:
    return words >> np.uint64(HEAD_BITS)


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (tails(right) << np.uint64(HEAD_BITS)) | (left >> np.uint64(64 - HEAD_BITS))


def contexts(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The word before each word; at a text's start, a mark of its own."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    before[first] = START
    return before


def parts_of(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column(text)):
            yield batch.slice(lo, hi - lo)


def bigram_counts(labelled: DataFrame) -> DataFrame:
    """pair with ``t`` and ``o``, its count in toxic and in other documents, and ``ft`` and ``fo``, those where ``fitted``."""
    made = ["t", "o", "ft", "fo"]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, "text"):
            words, bounds = word_hashes(batch.column("text"))
            if not len(words):
                continue
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
            fitted = batch.column("fitted").to_numpy(zero_copy_only=False).astype(bool)
            kind = np.repeat(toxic + 2 * fitted, np.diff(bounds))
            pairs, which = np.unique(pair_keys(contexts(words, bounds), words), return_inverse=True)
            k = np.bincount(which * 4 + kind, minlength=4 * len(pairs)).reshape(-1, 4)
            values = [k[:, 1] + k[:, 3], k[:, 0] + k[:, 2], k[:, 3], k[:, 2]]
            yield pa.record_batch([pa.array(pairs.view(np.int64)), *(pa.array(v.astype(np.int64)) for v in values)], names=["pair", *made])
        give_back()

    rows = labelled.select("text", "toxic", "fitted").mapInArrow(count, "pair long, " + ", ".join(f"{c} long" for c in made))
    return rows.groupBy("pair").agg(*[F.sum(c).alias(c) for c in made])


def _g2(t: Column, o: Column, share: Column) -> Column:
    """Likelihood-ratio statistic of a split (t, o) against the expected toxic share."""
    n = t + o
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    return 2 * (part(t, n * share) + part(o, n * (1 - share)))


def fit_expressions(pairs: DataFrame, discount: float = 0.75, evidence: float = 15.0, vocabulary_rows: int = 6_000_000, table_rows: int = 24_000_000) -> Expressions:
    """key and llr of every expression of ``pairs``, by kind, and whether it is ``strong`` (well attested).

    All pairs are counted; bigrams are given only where ``used``, that is where a text to be scored can have them.
    A bigram (2) that was counted speaks for its second word alone; any other is its head (3) and its second word (1)
    together, where a head never counted says nothing and a word never counted speaks as ``unseen`` does.
    """
    pairs = pairs.withColumns({"w": F.shiftrightunsigned("pair", HEAD_BITS), "h": F.col("pair").bitwiseAND(F.lit((1 << HEAD_BITS) - 1))})
    # How many different expressions a class has met, for the weight of its backoff.
    met = [F.count_if(F.col("t") > 0).alias("mt"), F.count_if(F.col("o") > 0).alias("mo"), F.count(F.lit(1)).alias("cont")]
    sums = [F.sum("t").alias("t"), F.sum("o").alias("o")]
    words = materialize(pairs.groupBy("w").agg(*sums, F.count(F.lit(1)).alias("cont")), "tox-words")
    total = words.agg(*sums, F.sum("cont").alias("cont"), F.count_if(F.col("t") > 0).alias("mt"), F.count_if(F.col("o") > 0).alias("mo")).first()
    if not total["t"] or not total["o"]:
        return Expressions(0.0, (), None)
    share = total["t"] / (total["t"] + total["o"])
    back = {c: discount * total[f"m{c}"] / total[c] for c in "to"}
    left = lambda n: F.greatest(n - discount, F.lit(0.0))
    scored = words.withColumns({f"p{c}": left(F.col(c)) / float(total[c]) + back[c] * F.col("cont") / float(total["cont"]) for c in "to"})
    ones = scored.select(F.lit(1).alias("kind"), F.col("w").alias("key"), F.log(F.col("pt") / F.col("po")).alias("llr"), (_g2(F.col("t"), F.col("o"), F.lit(share)) >= evidence).alias("strong"))
    heads = pairs.groupBy("h").agg(F.sum("t").alias("ht"), F.sum("o").alias("ho"), *met)
    heads = heads.withColumns({
        "lt": F.when(F.col("ht") > 0, discount * F.col("mt") / F.col("ht")).otherwise(1.0),
        "lo": F.when(F.col("ho") > 0, discount * F.col("mo") / F.col("ho")).otherwise(1.0),
        "lam": discount * F.col("cont") / (F.col("ht") + F.col("ho")),
    }).drop("mt", "mo", "cont")
    heads = materialize(heads, "tox-heads")
    threes = heads.select(F.lit(3).alias("kind"), F.col("h").alias("key"), F.log(F.col("lt") / F.col("lo")).alias("llr"), F.lit(False).alias("strong"))
    # A bigram's evidence is held against what its second word alone says.
    tail = scored.select("w", "pt", "po", ((F.col("t") + share) / (F.col("t") + F.col("o") + 1)).alias("ws"))
    shown = pairs.where("used").select("pair", "t", "o", "w", "h")
    many, vocabulary = words.count() + heads.count(), ()
    if many <= vocabulary_rows:
        vocabulary = write_lookup(tail, "tox-tails"), write_lookup(heads.select("h", *[F.col(c).cast("double").alias(c) for c in ("ht", "ho", "lt", "lo", "lam")]), "tox-contexts")
        joined = looked_up(shown, *vocabulary)
    else:
        joined = shown.join(tail, "w").join(heads, "h")
    sure = (F.col("t") + F.col("o") >= 3) & (_g2(F.col("t"), F.col("o"), F.col("ws")) >= evidence)
    pooled = left(F.col("t") + F.col("o")) / (F.col("ht") + F.col("ho"))
    prob = {c: left(F.col(c)) / F.greatest(F.col(f"h{c}"), F.lit(1)) + F.col(f"l{c}") * (pooled + F.col("lam") * F.col(f"p{c}")) for c in "to"}
    twos = joined.select(F.lit(2).alias("kind"), F.col("pair").alias("key"), F.log(prob["t"] / prob["o"]).alias("llr"), sure.alias("strong"))
    unseen = float(np.float32(np.log(back["t"] / back["o"])))
    kinds = [k.withColumn("llr", F.col("llr").cast("float")) for k in (ones, twos, threes)]
    if many + shown.count() > table_rows:
        made = Expressions(unseen, (), materialize(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]), "tox-expressions"))
    else:
        one, three = (write_lookup(k.drop("kind"), "tox-expressions") for k in (kinds[0], kinds[2]))
        if vocabulary:  # the bigrams need no more than these
            clear(words, heads)
        made = Expressions(unseen, (one, write_lookup(kinds[1].drop("kind"), "tox-expressions"), three), None)
    for table in vocabulary:
        table.drop(pairs.sparkSession)
    return made


def clear(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            drop_folder(table.sparkSession, folder)


def looked_up(pairs: DataFrame, *tables: Lookup) -> DataFrame:
    """``pairs`` with the values of tables whose keys are columns of it, every key of which is there: no shuffle."""
    added = [c for table in tables for c in table.names[1:]]

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [pa.array(v, pa.float64()) for table in tables for v in table.find(batch.column(table.names[0]).to_numpy())[1]]
            yield pa.record_batch([*batch.columns, *values], names=[*batch.schema.names, *added])
        close_mapped()

    return pairs.mapInArrow(look, ", ".join([*(f"{c} long" for c in pairs.columns), *(f"{c} double" for c in added)]))


@dataclass(frozen=True)
class Expressions:
    """Log-likelihood ratios of words (kind 1), bigrams (2) and heads (3): tables that workers share, or one that is joined."""

    unseen: float
    tables: tuple[Lookup, ...]
    joined: DataFrame | None

    def drop(self, spark: SparkSession) -> None:
        for table in self.tables:
            table.drop(spark)


def sums(unseen: float, tables: tuple[Lookup, ...], words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log-likelihood ratio of each text, and the strong expressions' part of it."""
    if not len(words) or not tables:
        return np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
    pairs, which = np.unique(pair_keys(contexts(words, bounds), words).view(np.int64), return_inverse=True)
    plain = pairs.view(np.uint64)
    seen, (one, one_strong) = tables[0].find(tails(plain).view(np.int64))
    hit, (two, two_strong) = tables[1].find(pairs)
    head = tables[2].find((plain & np.uint64((1 << HEAD_BITS) - 1)).view(np.int64))[1][0]
    one, two, head = (x.astype(np.float64) for x in (one, two, head))
    full = np.where(hit, two, np.where(seen, one, unseen) + head)
    strong = np.where(two_strong, two, np.where(one_strong, one, 0.0))
    upto = [np.concatenate([[0.0], np.cumsum(x[which])]) for x in (full, strong)]
    return tuple(x[bounds[1:]] - x[bounds[:-1]] for x in upto)


def totals(docs: DataFrame, expressions: Expressions, keep: list[str]) -> DataFrame:
    """``keep`` of every row of ``docs`` with ``llr`` (summed over its words), ``strong`` (part of it) and ``n`` (its words)."""
    spark = docs.sparkSession
    schema = docs.select(*keep).withColumns({"llr": F.lit(0.0), "strong": F.lit(0.0), "n": F.lit(0).cast("long")}).schema
    text, row = private(keep, "_text"), private(keep, "_row")
    source = docs.select(*keep, F.col("text").alias(text))
    bounded_batches(spark)
    if expressions.joined is None:
        unseen, tables = expressions.unseen, expressions.tables

        def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts_of(batches, text):
                words, bounds = word_hashes(batch.column(text))
                values = [*map(pa.array, sums(unseen, tables, words, bounds)), pa.array(np.diff(bounds).astype(np.int64))]
                yield pa.record_batch([*(batch.column(c) for c in keep), *values], names=[*keep, "llr", "strong", "n"])
            close_mapped()
            give_back()

        return source.mapInArrow(score, schema)
    rows = materialize(source.withColumn(row, F.monotonically_increasing_id()), "tox-rows")

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, text):
            words, bounds = word_hashes(batch.column(text))
            which = np.repeat(batch.column(row).to_numpy(zero_copy_only=False), np.diff(bounds))
            pair = pair_keys(contexts(words, bounds), words) if len(words) else words
            yield pa.record_batch([pa.array(which), pa.array(pair.view(np.int64))], names=["_row", "pair"])

    said = rows.select(row, text).mapInArrow(spread, "_row long, pair long").groupBy("_row", "pair").agg(F.count(F.lit(1)).alias("k"))
    table = lambda kind, key, name: expressions.joined.where(F.col("kind") == kind).select(
        F.col("key").alias(key), F.col("llr").cast("double").alias(name), F.col("strong").alias(name + "_strong")
    )
    apart = F.coalesce("_one", F.lit(expressions.unseen)) + F.coalesce("_head", F.lit(0.0))
    strong = F.when(F.col("_two_strong"), F.col("_two")).when(F.col("_one_strong"), F.col("_one")).otherwise(0.0)
    said = said.withColumns({"w": F.shiftrightunsigned("pair", HEAD_BITS), "h": F.col("pair").bitwiseAND(F.lit((1 << HEAD_BITS) - 1))})
    summed = (
        said.join(table(1, "w", "_one"), "w", "left").join(table(3, "h", "_head"), "h", "left").join(table(2, "pair", "_two"), "pair", "left").groupBy("_row")
        .agg(F.sum(F.coalesce(F.col("_two"), apart) * F.col("k")).alias("llr"), F.sum(strong * F.col("k")).alias("strong"), F.sum("k").alias("n"))
    )
    ratios = [F.coalesce(f"_sum_{c}", F.lit(0.0)).alias(c) for c in ("llr", "strong")]
    summed = summed.select(F.col("_row").alias("_own"), *[F.col(c).alias(f"_sum_{c}") for c in ("llr", "strong", "n")])
    joined = rows.select(F.struct(*keep).alias("_all"), F.col(row).alias("_mine")).join(summed, F.col("_mine") == F.col("_own"), "left")
    return joined.select(F.struct("_all.*", *ratios, F.coalesce("_sum_n", F.lit(0)).cast("long").alias("n")).alias("_out")).select("_out.*")


def features(llr, strong, n):
    """Bias, and of the strong expressions' ratio and the others': by word, damped by length, and total."""
    n1, rest = np.maximum(n, 1.0), llr - strong
    return np.stack([np.ones_like(llr), *(f for x in (strong, rest) for f in (10 * x / n1, x / np.sqrt(n1), np.tanh(x / 8.0)))], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    beta, damp = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + damp, x.T @ (y - p) - damp @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score_toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column, keep: list[str] | None = None, fit_rows: int = 20_000,
                   label_broadcast_rows: int = 1_000_000, table_rows: int = 24_000_000, vocabulary_rows: int = 6_000_000) -> DataFrame:
    """``docs`` (its columns in ``keep``, by default all) with llr, n and score; learns where ``learn_from`` holds.

    ``learn_from`` is a condition on doc_id. The logistic function is fitted on about ``fit_rows`` labelled documents.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("llr", "strong", "n", "score")]
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn_from).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known, "tox-labels")
    size = known.count()
    side = F.broadcast(known) if size <= label_broadcast_rows else known
    labelled = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(side, "doc_id")
    # The rows of the logistic step are at most about a fifth, so that the others' counts can stand for them.
    near = (F.xxhash64(F.lit("fit"), F.col("doc_id")) / F.lit(2.0**64)) + 0.5 < min(0.2, fit_rows / max(1, size))
    # Sorted, since neighbours then share their first bytes, in the file as in the shuffles that read it.
    pairs = materialize(bigram_counts(labelled.withColumn("fitted", near)).sortWithinPartitions("pair"), "tox-pairs", codec="zstd")
    bounds = {"vocabulary_rows": vocabulary_rows, "table_rows": table_rows}
    rest = pairs.select("pair", (F.col("t") - F.col("ft")).alias("t"), (F.col("o") - F.col("fo")).alias("o"), (F.col("ft") + F.col("fo") > 0).alias("used")).where("t + o > 0")
    others = fit_expressions(rest, **bounds)
    sample = totals(labelled.where(near), others, ["doc_id", "toxic"]).toArrow().to_pandas()
    others.drop(docs.sparkSession)
    expressions = fit_expressions(pairs.select("pair", "t", "o", F.lit(True).alias("used")), **bounds)
    if not sample["llr"].any() or len(set(sample["toxic"] > 0)) < 2:  # the others, or too few rows, tell the classes apart nowhere
        sample = totals(labelled.where(near) if size > fit_rows else labelled, expressions, ["doc_id", "toxic"]).toArrow().to_pandas()
    y = (sample["toxic"].to_numpy(dtype=float) > 0).astype(float)
    order = np.lexsort((sample["strong"], sample["llr"], sample["n"], sample["doc_id"]))
    if len(y) and 0 < y.mean() < 1:
        beta = fit_logistic(features(*(sample[c].to_numpy(float) for c in ("llr", "strong", "n")))[order], y[order])
    else:
        mean = min(max(y.mean() if len(y) else 0.0, 1e-6), 1 - 1e-6)
        beta = np.array([np.log(mean / (1 - mean)), *[0.0] * 6])
    n1, strong = F.greatest(F.col("n"), F.lit(1)), F.col("strong")
    parts = [f for x in (strong, F.col("llr") - strong) for f in (10 * x / n1, x / F.sqrt(n1), F.tanh(x / 8.0))]
    logit = sum((float(b) * f for b, f in zip(beta[1:], parts)), F.lit(float(beta[0])))
    return totals(docs, expressions, keep).withColumn("score", 1 / (1 + F.exp(-logit))).drop("strong")
