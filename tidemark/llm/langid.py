"""Language identification: blended-spectrum string kernels, Nystroem landmarks, one-versus-rest kernel ridge.

A piece of text is the set of its byte n-grams for n = 1..order (hashed into ``2**bits`` buckets), with letters folded
to lower case. The kernel of two pieces is the number of n-grams in both, over the root of the product of their set
sizes; a text longer than ``piece`` bytes is the mean of its pieces, by their bytes, so that a text of any length stays
apart from others. Landmarks are pieces of labelled texts; the ridge is solved in the Nystroem space they span, and its
solution folds back into one weight per (n-gram, language). Scoring is then a product of a block's presence sets with
that weight matrix, divided by each piece's own norm: the same numbers as kernel values against every landmark.

The classifier is fitted on about ``per_language`` labelled rows of each language and about ``landmarks`` pieces (picked
by a hash of doc_id and text), documented bounds; texts are read whole, in training and in scoring. Kernel values are
computed where the sample lies; the driver gets a row of ``landmarks`` numbers for each row of it. Scoring needs no shuffle.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with nothing to learn from every text is
``und``; a null doc_id counts as not held out but is scored alike; ties go to the language first in code-point order;
equal rows get equal results; extra columns are ignored, and the columns made here replace clashing ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, materialize, private
from tidemark.llm.textcore import LOWER, buffer_of, give_back, keep_nothing, slices

UNKNOWN = "und"
BLOCK_ROWS = 64


@dataclass(frozen=True)
class Spectrum:
    order: int = 4
    bits: int = 18
    piece: int = 16_384


def fold_case(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals to lower case, in UTF-8."""
    data = LOWER[data]
    after = np.zeros(len(data), dtype=bool)
    after[1:] = data[:-1] == 0xC3
    after &= (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    data[after] += 0x20
    return data


def pieces(offsets: np.ndarray, spectrum: Spectrum) -> tuple[np.ndarray, np.ndarray]:
    """(edges, owner): piece k is the bytes edges[k]..edges[k+1] of text owner[k]; an empty text has none."""
    counts = -(-np.diff(offsets) // spectrum.piece)
    owner = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.append(offsets[owner] + nth * spectrum.piece, offsets[-1]), owner


def presence(data: np.ndarray, edges: np.ndarray, spectrum: Spectrum) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks (first piece, buckets, bounds): piece first + j has the n-gram buckets of bounds[j]..bounds[j+1]."""
    width = 1 << spectrum.bits
    seen = np.zeros(BLOCK_ROWS * width, dtype=np.bool_)
    data = fold_case(data)
    for first in range(0, len(edges) - 1, BLOCK_ROWS):
        cut = edges[first : first + BLOCK_ROWS + 1] - edges[first]
        part = data[edges[first] : edges[first] + cut[-1]].astype(np.uint64) + np.uint64(1)
        sizes = np.diff(cut)
        row = np.repeat(np.arange(len(sizes), dtype=np.int64) * width, sizes)
        room = np.repeat(cut[1:], sizes) - np.arange(len(part))
        code = np.zeros(len(part), dtype=np.uint64)
        for n in range(1, spectrum.order + 1):
            code = code * np.uint64(0x9E3779B97F4A7C15)
            code[: max(0, len(part) - n + 1)] += part[n - 1 :]
            bucket = ((code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n) >> np.uint64(64 - spectrum.bits)).astype(np.int64)
            seen[(row + bucket)[room >= n]] = True
        flat = np.flatnonzero(seen[: len(sizes) * width])
        seen[flat] = False
        yield first, flat & (width - 1), np.searchsorted(flat, np.arange(len(sizes) + 1) * width)


def has_letter(texts: pa.Array) -> np.ndarray:
    plain = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False).to_numpy(zero_copy_only=False).astype(bool)
    for k in np.flatnonzero(~plain).tolist():
        text = texts[k].as_py()
        plain[k] = bool(text) and any(c.isalpha() for c in text)
    return plain


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    spectrum: Spectrum
    sharpness: float = 8.0

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """texts x languages: the mean over a text's pieces, by their bytes."""
        edges, owner = pieces(offsets, self.spectrum)
        out, share = np.zeros((len(offsets) - 1, len(self.languages))), np.diff(edges) / np.maximum(np.diff(offsets)[owner], 1)
        for first, grams, bounds in presence(data, edges, self.spectrum):
            sums = np.add.reduceat(self.weights[grams], bounds[:-1], axis=0)
            at = slice(first, first + len(sums))
            np.add.at(out, owner[at], sums / np.sqrt(np.diff(bounds))[:, None] * share[at, None])
        return out + self.bias


def training_sample(docs: DataFrame, learn_from: Column, per_language: int, per_mark: int) -> DataFrame:
    """lang and text of about ``per_language`` rows of each language, by hash; ``mark`` is set on about ``per_mark``."""
    known = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return known.select("lang", "text", F.lit(False).alias("mark")).where(F.lit(False))
    share = lambda most: F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, most / n)))])[F.col("lang")]
    draw = (F.xxhash64(F.lit("langid"), F.col("doc_id"), F.col("text")) / F.lit(2.0**64)) + 0.5
    return known.where(draw < share(per_language)).select("lang", "text", (draw < share(per_mark)).alias("mark"))


class Landmarks:
    """Sets of n-gram buckets, one after another, and the kernel of other sets with each of them."""

    def __init__(self, sets: list[np.ndarray], width: int) -> None:
        self.sizes = np.array([len(s) for s in sets], dtype=np.float64)
        self.flat, self.starts, self.width = np.concatenate(sets), np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64), width

    def kernel(self, grams: np.ndarray) -> np.ndarray:
        has = np.zeros(self.width, dtype=np.bool_)
        has[grams] = True
        return np.add.reduceat(has[self.flat], self.starts, dtype=np.int64) / np.sqrt(self.sizes * max(len(grams), 1))


def fit(docs: DataFrame, learn_from: Column | None = None, per_language: int = 400, landmarks: int = 320,
        ridge: float = 1e-2, spectrum: Spectrum | None = None) -> Model:
    """Learn from the text and lang of the rows of ``docs`` where ``learn_from`` holds."""
    spectrum = spectrum or Spectrum()
    width = 1 << spectrum.bits
    # About 80 landmarks a language, as of four languages; more languages have more, a bound by their number.
    sample = materialize(training_sample(docs, F.lit(True) if learn_from is None else learn_from, per_language, max(1, landmarks // 4)), "lang-sample")

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            edges, owner = pieces(offsets, spectrum)
            middle = np.searchsorted(owner, np.arange(len(batch))) + np.bincount(owner, minlength=len(batch)) // 2
            sets: list = [None] * len(batch)
            for first, grams, bounds in presence(data, edges, spectrum):
                for j in range(len(bounds) - 1):
                    if middle[owner[first + j]] == first + j:
                        sets[owner[first + j]] = grams[bounds[j] : bounds[j + 1]].astype(np.int32)
            yield pa.record_batch([batch.column("lang"), pa.array(sets, pa.list_(pa.int32()))], names=["lang", "grams"])
        give_back()

    marks = sample.where("mark").select("lang", "text").mapInArrow(mark, "lang string, grams array<int>").where("grams is not null").toArrow()
    sets = [g.values.to_numpy() for g in marks["grams"]]
    names = marks["lang"].to_pylist()
    order = sorted(range(len(sets)), key=lambda k: (names[k], len(sets[k]), sets[k].tobytes()))  # the same order on every run
    sets = [sets[k] for k in order]
    if not sets:
        return Model((), np.zeros((1, 0), np.float32), np.zeros(0, np.float32), spectrum)
    space = Landmarks(sets, width)
    shared = sample.sparkSession.sparkContext.broadcast(space)  # ``landmarks`` sets of at most order x piece numbers

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            edges, owner = pieces(offsets, spectrum)
            out = np.zeros((len(batch), len(shared.value.sizes)))
            for first, grams, bounds in presence(data, edges, spectrum):
                for j in range(len(bounds) - 1):
                    text = owner[first + j]
                    out[text] += shared.value.kernel(grams[bounds[j] : bounds[j + 1]]) * (edges[first + j + 1] - edges[first + j]) / (offsets[text + 1] - offsets[text])
            yield pa.record_batch([batch.column("lang"), pa.array(list(out.astype(np.float32)), pa.list_(pa.float32()))], names=["lang", "kernel"])
        give_back()

    rows = sample.select("lang", "text").mapInArrow(place, "lang string, kernel array<float>").toArrow()  # a bounded sample
    shared.destroy()
    langs = np.array(rows["lang"].to_pylist(), dtype=object)
    kernel = rows["kernel"].combine_chunks().values.to_numpy().reshape(len(rows), -1).astype(np.float64)
    order = np.lexsort((*kernel.T[:8], langs))
    langs, kernel = langs[order], kernel[order]
    languages = tuple(sorted(set(langs)))
    values, vectors = np.linalg.eigh(np.stack([space.kernel(s) for s in sets]))
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = kernel @ root
    goal = np.where(langs[:, None] == np.array(languages, dtype=object)[None, :], 1.0, -1.0)
    # Each language weighs alike whatever its number of rows.
    many = Counter(langs)
    weight = np.array([1.0 / many[x] for x in langs])[:, None]
    centre, level = (phi * weight).sum(0) / weight.sum(), (goal * weight).sum(0) / weight.sum()
    a, b = phi - centre, goal - level
    alpha = np.linalg.solve(a.T @ (a * weight) + ridge * np.eye(a.shape[1]) / len(languages), a.T @ (b * weight))
    each, weights = root @ alpha, np.zeros((width, len(languages)), dtype=np.float32)
    for grams, own in zip(sets, each, strict=True):
        weights[grams] += (own / np.sqrt(len(grams))).astype(np.float32)
    return Model(languages, weights, (level - centre @ alpha).astype(np.float32), spectrum)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns in ``keep``, by default all) with ``lang_pred`` and ``score``."""
    bounded_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers, whatever the corpus
    schema = docs.select(*keep).withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema
    held = "text" if "text" in keep else private(keep, "text")

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            best, sure = np.full(len(batch), len(names) - 1), np.zeros(len(batch))
            if model.languages:
                for lo, hi in slices(batch.column(held), 2_000_000):
                    got = model.score(*buffer_of(batch.column(held)[lo:hi]))
                    best[lo:hi] = got.argmax(axis=1)
                    odds = np.exp(model.sharpness * (got - got.max(axis=1, keepdims=True)))
                    sure[lo:hi] = 1 / odds.sum(axis=1)
                none = ~has_letter(batch.column(held))
                best[none], sure[none] = len(names) - 1, 0.0
            columns = [batch.column(c) for c in keep]
            yield pa.record_batch([*columns, pa.array(names[best], pa.string()), pa.array(sure, pa.float64())], names=[*keep, "lang_pred", "score"])
        give_back()

    source = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias(held))
    return source.mapInArrow(label, schema)
