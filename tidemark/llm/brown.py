"""Language-model scores of texts by a Brown class bigram model.

Words (runs of anything but ``\\x20\\x09-\\x0D``, A-Z lower-cased) are counted over all texts learnt from; an end closes every text
and opens the next. A word whose share of all tokens is at least ``share`` is *frequent*: by their shares there are at most
``1/share`` such words, so each worker holds their list. They are put into classes by exchange: in each round a part of them
may move, each to the class that raises the likelihood of the class bigrams most. A word's neighbours by class are counted
where the texts lie, summed by word in a shuffle, and the words of a bucket move one after the other on their own copy of
the class matrix; rounds go over all the frequent words ``sweeps`` times. Every other word, however rare, then takes the class that
its neighbours speak for most, through one shuffle by word; its class and count reach the texts by a join. No word,
bigram or text is left out of any count.

A token's probability is that of its class after the class before times that of the word in its class. Both are discounted
(by the counts of counts of words, and of class bigrams): what words give up is the class's share for a word never met,
what transitions give up goes to the classes' frequencies. After a word never met stands what follows words met once. The
probabilities of all known words, the end and the one unknown word add up to one after every class.

Defined cases: a null text is an empty one, whose only token is the end; a null doc_id counts as any other; equal rows get equal
scores and count each; without texts to learn from, every token has the same probability for end or unknown, and the base
score is 0; columns named like those added give way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, fresh_path, materialize, private
from tidemark.llm.textcore import give_back, slices

#: The end of a text among codes; codes from 0 are frequent words, below 0 the text's other words.
END = np.int32(2**31 - 1)
#: Marks a word met once among the classes of a text: after it counts as after a word never met.
ONCE = 1 << 15
SLICE = 4_000_000
#: Frequent words in a bucket of the exchange, and (word, neighbour class) counts held before they are sent.
BUCKET, HELD = 2_000, 4_000_000


@dataclass
class Brown:
    """A model: frequent words with counts and classes, the table of all others, and what is counted by class."""

    words: pa.Array
    counts: np.ndarray
    n: int
    vocabulary: int
    texts: int
    classes: int
    of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    rare: DataFrame | None = None
    tokens: np.ndarray = field(default_factory=lambda: np.zeros(0))
    types: np.ndarray = field(default_factory=lambda: np.zeros(0))
    discount: float = 0.5
    log_next: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @property
    def base(self) -> float:
        return math.log10(self.n + 0.5 * (self.vocabulary + 1))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, int]:
    """(words, text of each word, number of texts)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    which = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.not_equal(words, pa.scalar("", words.type))
    return words.filter(real), which[real.to_numpy(zero_copy_only=False)], len(lists)


def parts_of(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column(text), SLICE):
            yield batch.slice(lo, hi - lo)
    give_back()


def count_words(texts: DataFrame) -> DataFrame:
    """word and c over the column ``text``; a batch's repeats are added up before anything is sent."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, "text"):
            found = words_of(batch.column("text"))[0].value_counts()
            yield pa.record_batch([found.field(0).cast(pa.string()), found.field(1)], names=["word", "c"])

    return texts.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def encode(docs: DataFrame, keep: list[str], text: str, words: pa.Array) -> DataFrame:
    """``keep`` of every row with its codes (little-endian 32-bit, closed by ``END``) and its different other words."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(words)
    schema = docs.select(*keep).withColumns({"_codes": F.lit(b""), "_rare": F.array(F.lit("")), "_n_rare": F.lit(0)}).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, text):
            found, which, n = words_of(batch.column(text))
            coded = found.dictionary_encode()
            unique, place = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            known = pc.fill_null(pc.index_in(unique, value_set=held.value.cast(unique.type)), -1).to_numpy(zero_copy_only=False)
            code = known[place] if len(place) else np.zeros(0, np.int32)
            other = code < 0
            pairs, at = np.unique(which[other] * max(1, len(unique)) + place[other], return_inverse=True)
            owner = pairs // max(1, len(unique))
            first = np.searchsorted(owner, np.arange(n + 1))
            code = code.astype(np.int32)
            code[other] = -1 - (at - first[which[other]])
            lengths = np.bincount(which, minlength=n) + 1
            ends = np.cumsum(lengths)
            out = np.full(int(ends[-1]) if n else 0, END, dtype="<i4")
            out[np.arange(len(code)) + which] = code
            offsets = pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32))
            codes = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(out)])
            rare = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), unique.take(pa.array(pairs % max(1, len(unique)))).cast(pa.string()))
            count = pa.array(np.diff(first).astype(np.int32))
            yield pa.record_batch([*(batch.column(c) for c in keep), codes, rare, count], names=[*keep, "_codes", "_rare", "_n_rare"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def sequence(column: pa.Array, dtype: str = "<i4") -> np.ndarray:
    """All codes of a binary column, one text after the other."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(dtype) if data is not None else np.zeros(0, dtype)


def neighbours(codes: np.ndarray, of: np.ndarray, end: int, other: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each token, class of the one before): ``end`` for ends, ``other`` for words that are not frequent."""
    now = np.full(len(codes), other, dtype=np.int64)
    frequent = (codes >= 0) & (codes != END)
    now[frequent] = of[codes[frequent]]
    now[codes == END] = end
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[:1] = end
    return now, before


def totals(rows: DataFrame, size: int, terms: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of ``terms`` of all batches, ``size`` numbers: in each task first, then by place."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += terms(batch)
        places = np.flatnonzero(total)
        yield pa.record_batch([pa.array(places.astype(np.int32)), pa.array(total[places])], names=["place", "c"])

    out = np.zeros(size, np.int64)
    for place, c in rows.mapInArrow(add, "place int, c long").groupBy("place").agg(F.sum("c").alias("c")).collect():
        out[place] = c
    return out


def class_matrix(encoded: DataFrame, of: np.ndarray, k: int) -> np.ndarray:
    """Counts of class bigrams; class ``k`` is the end, ``k + 1`` holds all words that are not frequent."""
    width = k + 2

    def terms(batch: pa.RecordBatch) -> np.ndarray:
        now, before = neighbours(sequence(batch.column(0)), of, k, k + 1)
        return np.bincount(before * width + now, minlength=width * width)

    return totals(encoded.select("_codes"), width * width, terms).reshape(width, width)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(m: np.ndarray) -> float:
    """What of the log-likelihood of the class bigrams depends on the classes."""
    m = m.astype(float)
    return float(xlogx(m).sum() - xlogx(m.sum(0)).sum() - xlogx(m.sum(1)).sum())


class Exchange:
    """Class bigram counts from which words are taken and to which they are added, one at a time."""

    def __init__(self, matrix: np.ndarray, k: int) -> None:
        self.m, self.k = matrix.astype(float), k
        self.out, self.into = self.m.sum(1), self.m.sum(0)

    def _shift(self, c: int, left: np.ndarray, right: np.ndarray, same: float, sign: int) -> None:
        self.m[c, :] += sign * right
        self.m[:, c] += sign * left
        self.m[c, c] += sign * same
        self.out += sign * left
        self.into += sign * right
        self.out[c] += sign * (right.sum() + same)
        self.into[c] += sign * (left.sum() + same)

    def best(self, c: int, left: np.ndarray, right: np.ndarray, same: float) -> int:
        """The class that a word now in ``c`` belongs to; it is put there. ``left`` and ``right`` count its neighbours by class
        without itself, ``same`` how often it follows itself. On a tie it stays, or takes the smallest."""
        self._shift(c, left, right, same, -1)
        m, k, n = self.m, self.k, right.sum() + same
        a, b = np.flatnonzero(right), np.flatnonzero(left)
        gain = (xlogx(m[:k, a] + right[a]) - xlogx(m[:k, a])).sum(1) + (xlogx(m[b, :k] + left[b, None]) - xlogx(m[b, :k])).sum(0)
        d, r, f = np.diagonal(m)[:k], right[:k], left[:k]
        gain += xlogx(d + r + f + same) - xlogx(d + r) - xlogx(d + f) + xlogx(d)
        # Whatever the class, the word's neighbours are followed and preceded by it.
        out, into = self.out[:k] + left[:k], self.into[:k] + right[:k]
        gain -= xlogx(out + n) - xlogx(out) + xlogx(into + n) - xlogx(into)
        to = int(np.argmax(gain))
        if gain[to] <= gain[c] + 1e-9 * abs(gain[c]):
            to = c
        self._shift(to, left, right, same, 1)
        return to


def profiles(encoded: DataFrame, of: np.ndarray, k: int, part: int, parts: int, buckets: int) -> DataFrame:
    """bucket, keys and counts: how often each frequent word of the part stands beside each class, by task.

    A key is the word's place in its bucket times ``2 * (k + 2) + 1``, plus the class before, or ``k + 2`` and the class after, or
    ``2 * (k + 2)`` where the word follows itself."""
    width = k + 2
    places = 2 * width + 1

    def keys_of(codes: np.ndarray) -> np.ndarray:
        now, before = neighbours(codes, of, k, k + 1)
        after = np.empty_like(now)
        after[:-1] = now[1:]
        after[-1:] = k
        mine = np.flatnonzero((codes >= 0) & (codes != END) & (codes % parts == part))
        word = codes[mine].astype(np.int64) * places
        padded = np.concatenate([[END], codes, [END]])
        follows, followed = padded[mine] == codes[mine], padded[mine + 2] == codes[mine]
        return np.concatenate([np.where(follows, word + 2 * width, word + before[mine]), (word + width + after[mine])[~followed]])

    def merged(held: list) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([h[0] for h in held])
        found, at = np.unique(keys, return_inverse=True)
        return found, np.bincount(at, np.concatenate([h[1] for h in held]), len(found)).astype(np.int64)

    def packed(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        word, place = keys // places, keys % places
        bucket, local = word % buckets, (word // buckets) * places + place
        order = np.lexsort((local, bucket))
        bucket, local, n = bucket[order], local[order], n[order]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        full = [b for b in range(buckets) if edges[b] < edges[b + 1]]
        cut = lambda x, kind: [x[edges[b] : edges[b + 1]].astype(kind).tobytes() for b in full]
        return pa.record_batch([pa.array(full, pa.int32()), pa.array(cut(local, "<i8"), pa.binary()), pa.array(cut(n, "<i8"), pa.binary())], names=["bucket", "keys", "counts"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys, n = np.unique(keys_of(sequence(batch.column(0))), return_counts=True)
            held.append((keys, n))
            size += len(keys)
            if size > HELD:
                held = [merged(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield packed(*held[0])
                    held, size = [], 0
        if size:
            yield packed(*merged(held))
        give_back()

    return encoded.select("_codes").mapInArrow(run, "bucket int, keys binary, counts binary")


def moved(found: DataFrame, of: np.ndarray, matrix: np.ndarray, k: int, buckets: int) -> DataFrame:
    """word and the class it moves to; ``found`` of ``profiles``."""
    width = k + 2
    places = 2 * width + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, keys, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "counts")), strict=True):
                if b not in dense:
                    dense[b] = np.zeros((-(-len(of) // buckets)) * places, np.int64)
                dense[b][np.frombuffer(keys, "<i8")] += np.frombuffer(n, "<i8")
        out = []
        for b in sorted(dense):
            state, rows = Exchange(matrix, k), dense.pop(b).reshape(-1, places)
            for local in np.flatnonzero(rows.any(1)):
                word, row = int(local) * buckets + b, rows[local].astype(float)
                to = state.best(int(of[word]), row[:width], row[width : 2 * width], row[2 * width])
                if to != of[word]:
                    out.append((word, to))
        if out:
            yield pa.record_batch([pa.array(c, pa.int32()) for c in zip(*out, strict=True)], names=["word", "to"])
        give_back()

    return found.repartition(buckets, "bucket").mapInArrow(run, "word int, to int")


def exchanged(encoded: DataFrame, words: int, k: int, sweeps: int, parts: int) -> np.ndarray:
    """The class of each frequent word."""
    of = np.arange(words, dtype=np.int64) % k
    buckets = max(1, min(64, -(-words // BUCKET)))
    for turn in range(sweeps * parts if words > 1 and k > 1 else 0):
        matrix = class_matrix(encoded, of, k)
        changes = moved(profiles(encoded, of, k, turn % parts, parts, buckets), of, matrix, k, buckets).toArrow()
        of = of.copy()
        of[changes["word"].to_numpy()] = changes["to"].to_numpy()
    return of


def fold_in(encoded: DataFrame, of: np.ndarray, k: int) -> DataFrame:
    """word, class and c of every word that is not frequent: the class its neighbours' classes speak for most."""
    width = k + 2
    matrix = class_matrix(encoded, of, k)
    out, into = matrix.sum(1)[:k], matrix.sum(0)[:k]
    speaks = np.concatenate([np.log(matrix[:, :k] + 0.5), np.log(matrix[:k].T + 0.5)])
    weight, met = np.log(out + 0.5) + np.log(into + 0.5), (out > 0) | ~out.any()

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = sequence(batch.column("_codes"))
            now, before = neighbours(codes, of, k, k + 1)
            mine = np.flatnonzero(codes < 0)
            text = np.cumsum(codes == END)[mine]
            first = np.concatenate([[0], np.cumsum(batch.column("_n_rare").to_numpy(zero_copy_only=False))])
            place = first[text] - 1 - codes[mine]
            order = np.argsort(place, kind="stable")
            sides = np.stack([before[mine], width + now[mine + 1]], axis=1)[order].astype("<u2")
            edges = np.searchsorted(place[order], np.arange(first[-1] + 1)) * 4
            beside = pa.Array.from_buffers(pa.binary(), int(first[-1]), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(sides))])
            yield pa.record_batch([batch.column("_rare").flatten(), beside], names=["word", "beside"])

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(2 * width)

        def put(words: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
            c = sums[:, :width].sum(1)
            to = np.argmax(np.where(met, sums @ speaks - c[:, None] * weight, -np.inf), axis=1)
            return pa.record_batch([words, pa.array(to.astype(np.int32)), pa.array(c.astype(np.int64))], names=["word", "class", "c"])

        for batch in batches:
            if not len(batch):
                continue
            runs = pc.run_end_encode(batch.column("word"))
            words, stops = runs.values, np.asarray(runs.run_ends)
            sides = sequence(batch.column("beside"), "<u2").astype(np.int64)
            lengths = pc.binary_length(batch.column("beside")).to_numpy(zero_copy_only=False) // 2
            run_of = np.repeat(np.searchsorted(stops, np.arange(len(batch)), side="right"), lengths)
            sums = np.bincount(run_of * 2 * width + sides, minlength=len(words) * 2 * width).reshape(len(words), -1).astype(float)
            if last is not None and words[0].as_py() == last:
                sums[0] += held
            elif last is not None:
                yield put(pa.array([last]), held[None])
            last, held = words[-1].as_py(), sums[-1]
            if len(words) > 1:
                yield put(words[:-1], sums[:-1])
        if last is not None:
            yield put(pa.array([last]), held[None])
        give_back()

    beside = encoded.where("_n_rare > 0").select("_codes", "_rare", "_n_rare").mapInArrow(spread, "word string, beside binary")
    return materialize(beside.repartition("word").sortWithinPartitions("word").mapInArrow(choose, "word string, class int, c long"), "lm-rare")


def discount_of(once: float, twice: float, low: float, high: float) -> float:
    return min(max(once / (once + 2 * twice) if once else low, low), high)


def fit_words(texts: DataFrame, classes: int, share: float) -> Brown:
    """Counts over ``texts`` and their frequent words; no classes yet."""
    vocabulary = materialize(count_words(texts), "lm-words")
    ends = texts.count()
    sums = vocabulary.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n = int(sums["n"] or 0) + ends
    frequent = vocabulary.where(F.col("c") >= max(1, math.ceil(share * n))).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    words = frequent["word"].combine_chunks()
    words = words.cast(pa.string()) if isinstance(words, pa.Array) else pa.array([], pa.string())
    return Brown(words, frequent["c"].to_numpy().astype(np.int64), n, sums["v"] + (ends > 0), ends, max(1, min(classes, len(words))))


def fit_classes(model: Brown, encoded: DataFrame, sweeps: int, parts: int) -> None:
    """Classes of all words of ``encoded`` (its texts are those learnt from), and counts by class."""
    k = model.classes
    model.of = exchanged(encoded, len(model.words), k, sweeps, parts)
    model.rare = fold_in(encoded, model.of, k)
    rare = model.rare.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"), *[F.count_if(F.col("c") == x).alias(f"n{x}") for x in (1, 2)]).collect()
    model.tokens = np.bincount(model.of, model.counts, k) if len(model.of) else np.zeros(k)
    model.types = np.bincount(model.of, minlength=k).astype(float)
    once, twice = (float((model.counts == x).sum() + sum(r[f"n{x}"] for r in rare)) for x in (1, 2))
    for r in rare:
        model.tokens[r["class"]] += r["c"]
        model.types[r["class"]] += r["v"]
    model.discount = discount_of(once, twice, 0.05, 0.9)


def resolve(model: Brown, encoded: DataFrame, keep: list[str], row: str) -> DataFrame:
    """``keep`` with the classes of each text's tokens (16 bits; ``ONCE`` marks words met once), n_tokens, n_known, base_score
    and the words' part of the score. ``row`` is a column of ``keep`` that names the row."""
    k, d = model.classes, model.discount
    asked = encoded.where("_n_rare > 0").select(F.col(row).alias("_at"), F.posexplode("_rare").alias("_j", "word"))
    told = asked.join(model.rare, "word").groupBy("_at").agg(F.collect_list(F.struct("_j", "class", "c")).alias("_told"))
    joined = encoded.drop("_rare").join(told, F.col(row) == F.col("_at"), "left").drop("_at")
    made = {"_classes": F.lit(b""), "n_tokens": F.lit(0).cast("long"), "n_known": F.lit(0).cast("long"), "base_score": F.lit(0.0), "_emitted": F.lit(0.0)}
    schema = encoded.select(*keep).withColumns(made).schema
    log_tokens = np.log10(np.maximum(model.tokens, 1))
    # Of each frequent word: its class, its share of its class, and what the base score takes.
    value = (model.of.astype(np.int64) | np.where(model.counts == 1, ONCE, 0), np.log10(np.maximum(model.counts - d, 1e-300)) - log_tokens[model.of], np.log10(model.counts + 0.5))
    held = encoded.sparkSession.sparkContext.broadcast(value)
    base, ends = model.base, model.texts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, emit, seen = held.value
        for batch in batches:
            codes = sequence(batch.column("_codes"))
            end = codes == END
            text = np.cumsum(end) - end
            first = np.concatenate([[0], np.cumsum(batch.column("_n_rare").to_numpy(zero_copy_only=False))])
            told = batch.column("_told")
            owner = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(told), 0).to_numpy(zero_copy_only=False))
            rows = told.flatten()
            j, their, c = (rows.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in (0, 1, 2))
            rare_class, rare_count = np.full(first[-1], k + 1, np.int64), np.zeros(first[-1])
            rare_class[first[owner] + j], rare_count[first[owner] + j] = their | np.where(c == 1, ONCE, 0), c
            now, said, plain, known = np.full(len(codes), k, np.int64), np.zeros(len(codes)), np.full(len(codes), np.log10(ends + 0.5)), np.full(len(codes), ends > 0)
            frequent = (codes >= 0) & ~end
            now[frequent], said[frequent], plain[frequent], known[frequent] = cls[codes[frequent]], emit[codes[frequent]], seen[codes[frequent]], True
            other = codes < 0
            at = first[text[other]] - 1 - codes[other]
            count, got = rare_count[at], rare_count[at] > 0
            now[other], plain[other], known[other] = rare_class[at], np.log10(count + 0.5), got
            said[other] = np.where(got, np.log10(np.maximum(count - d, 1e-300)) - log_tokens[np.where(got, rare_class[at] & (ONCE - 1), 0)], 0.0)
            n = np.bincount(text, minlength=len(batch))
            offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(n) * 2]).astype(np.int32))
            classes = pa.Array.from_buffers(pa.binary(), len(batch), [None, offsets, pa.py_buffer(now.astype("<u2"))])
            sums = [np.bincount(text, x, len(batch)) for x in (known, plain - base, said)]
            made = [classes, pa.array(n.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
            yield pa.record_batch([*(batch.column(c) for c in keep), *made], names=[*keep, "_classes", "n_tokens", "n_known", "base_score", "_emitted"])
        give_back()

    return joined.mapInArrow(run, schema)


def fit_transitions(model: Brown, resolved: DataFrame) -> None:
    """log10 probabilities of class (columns; the end is ``k``, a word never met ``k + 1``) after class (rows; ``k + 1``: after a
    word never met, as after words met once), from the classes of the texts learnt from."""
    k = model.classes
    width = k + 2

    def terms(batch: pa.RecordBatch) -> np.ndarray:
        marked = sequence(batch.column(0), "<u2").astype(np.int64)
        now, before = marked & (ONCE - 1), np.concatenate([[k], marked[:-1]])
        every = np.bincount((before & (ONCE - 1)) * width + now, minlength=width * width)
        once = before >= ONCE
        return every + np.bincount((k + 1) * width + now[once], minlength=width * width)

    counts = totals(resolved.select("_classes"), width * width, terms).reshape(width, width).astype(float)
    size = np.concatenate([model.tokens, [model.texts, 0]])
    there = size > 0
    there[k:] = True
    plain = np.where(there, size + 0.5, 0.0) / (size.sum() + 0.5 * there.sum())
    d = discount_of(float((counts == 1).sum()), float((counts == 2).sum()), 0.1, 0.9)
    total = counts.sum(1, keepdims=True)
    left = np.where(total > 0, d * (counts > 0).sum(1, keepdims=True) / np.maximum(total, 1), 1.0)
    after = np.maximum(counts - d, 0) / np.maximum(total, 1) + left * plain
    unmet = np.concatenate([np.where(model.tokens > 0, model.discount * model.types / np.maximum(model.tokens, 1), 0.0), [0.0, 1.0]])
    after[:, k + 1] = after @ unmet
    model.log_next = np.log10(np.maximum(after, 1e-300))


def scored(model: Brown, resolved: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, n_tokens, n_known, base_score and score."""
    k, log_next = model.classes, model.log_next
    schema = resolved.select(*keep, "n_tokens", "n_known", "base_score").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now = sequence(batch.column("_classes"), "<u2").astype(np.int64) & (ONCE - 1)
            before = np.concatenate([[k], now[:-1]])
            text = np.repeat(np.arange(len(batch)), batch.column("n_tokens").to_numpy(zero_copy_only=False))
            score = np.bincount(text, log_next[before, now], len(batch)) + batch.column("_emitted").to_numpy(zero_copy_only=False)
            kept = [batch.column(c) for c in (*keep, "n_tokens", "n_known", "base_score")]
            yield pa.record_batch([*kept, pa.array(score)], names=[*keep, "n_tokens", "n_known", "base_score", "score"])

    return resolved.mapInArrow(run, schema)


def _compact(df: DataFrame, tag: str) -> DataFrame:
    """Written like ``materialize``, but smaller: codes hardly shrink in the usual format."""
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def brown_scores(docs: DataFrame, learn_from: Column | None = None, keep: list[str] | None = None, classes: int = 64, share: float = 5e-7,
                 sweeps: int = 3, parts: int = 2) -> tuple[Brown, DataFrame]:
    """(model, rows): ``keep`` (by default all columns) of ``docs`` with n_tokens, n_known, base_score (log10 by single words) and score
    (the model's log10 probability of the text). Learns where ``learn_from`` holds (by default everywhere)."""
    if not 1 <= classes < ONCE - 2:
        raise ValueError(f"classes: {classes}")
    bounded_batches(docs.sparkSession)
    added = ("n_tokens", "n_known", "base_score", "score")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    taken = [*keep, "_codes", "_rare", "_n_rare", "_told", "_classes", "_emitted", "_at", "_j", "word", "class", "c", *added]
    row, learnt = private(taken, "_row"), private(taken, "_learnt")
    text = private([*taken, row, learnt], "_text")
    learn = F.lit(True) if learn_from is None else F.coalesce(learn_from, F.lit(False))
    # The caller's columns travel as one, so their names meet none of this module's.
    whole = docs.select(F.struct(*keep).alias("_kept") if keep else F.lit(0).alias("_kept"), learn.alias(learnt), F.monotonically_increasing_id().alias(row), F.col("text").alias(text))
    model = fit_words(whole.where(learnt).select(F.col(text).alias("text")), classes, share)
    own = ["_kept", learnt, row]
    encoded = _compact(encode(whole, own, text, model.words), "lm-codes")
    fit_classes(model, encoded.where(learnt), sweeps, parts)
    resolved = _compact(resolve(model, encoded, own, row), "lm-classes")
    fit_transitions(model, resolved.where(learnt))
    rows = scored(model, resolved, ["_kept"])
    return model, rows.select(*(["_kept.*"] if keep else []), *added)
