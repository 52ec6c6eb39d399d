"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Best-fit decreasing treats pieces of one length alike, and open bins of one remaining capacity alike. So the packing
is planned on the histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus): lengths go down, a
segment tree over remaining capacities names the tightest capacity with an open bin in logarithmic time, and as many
pieces as that capacity has bins move at once. The plan is exactly what placing the pieces one by one would give. It
is a list of runs "pieces of length L with ranks r..r+n stand in bins b..b+n at offset o"; pieces get their ranks by a
prefix sum over (length, bucket) totals and a window inside each bucket, so no length's pieces meet in one task.

Defined cases: a null text is empty and becomes one piece, the closing id alone; rows alike in every way are packed
each for itself; an empty table packs to nothing; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize
from tidemark.llm.textcore import give_back, keep_only


#: Characters encoded at a time: what a worker holds besides its batch is some sixty times as many bytes.
SLICE = 1_000_000


class TightestFit:
    """A segment tree over remaining capacities 0..capacity: which has open bins, found in O(log capacity)."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.width)

    def mark(self, left: int, has: bool) -> None:
        node = left + self.width
        self.open[node] = has
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def find(self, need: int) -> int | None:
        """The smallest remaining capacity >= need with an open bin."""
        node = need + self.width
        if self.open[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.width:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.width


def plan_packing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first bin, offset): best-fit decreasing over a histogram of lengths."""
    tree, bins = TightestFit(capacity), [[] for _ in range(capacity + 1)]  # bins: (first, count) by what is left
    runs, next_bin = [], 0
    for length in sorted((n for n in histogram if histogram[n]), reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            left = tree.find(length)
            if left is None:
                left, first, count = capacity, next_bin, -(-todo // (capacity // length))
                next_bin += count
            else:
                first, count = bins[left].pop()
            # What a bin has left after a piece is a tighter fit for the next one, so a bin fills up before another.
            each = left // length
            for fill, some in ((each, min(count, todo // each)), (todo % each, 1)):
                if fill and some and count and todo:
                    runs += [(length, rank + k * some, some, first, capacity - left + k * length) for k in range(fill)]
                    rest = left - fill * length
                    bins[rest].append((first, some))
                    tree.mark(rest, rest > 0)
                    rank, todo, first, count = rank + fill * some, todo - fill * some, first + some, count - some
            if count:
                bins[left].append((first, count))
            tree.mark(left, bool(bins[left]) and left > 0)
    return runs


# Byte-level BPE -------------------------------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: bytes that print stand for themselves, others for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in plain):
        table[chr(256 + k)] = b
    return table


class FastBytePairs:
    """The ids of a byte-level BPE vocabulary for a whole batch of texts.

    Texts are cut into the vocabulary's pre-tokens with array operations on code points, equal pre-tokens of a batch are
    encoded once, and the ids are gathered. Texts with characters outside the ranges whose classes are old and settled,
    with an apostrophe, or with one of the vocabulary's added tokens go through the tokenizers library as they are; tests
    hold both ways against each other.
    """

    SAFE = 0x250

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        model, self.added = parts["model"], sorted(t["content"] for t in parts.get("added_tokens", ()))
        special = set(self.added)
        del parts
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): k for token, k in model["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        letter, number, space = (np.zeros(self.SAFE, dtype=bool) for _ in range(3))
        import regex

        for k in range(self.SAFE):
            letter[k], number[k], space[k] = (regex.match(p, chr(k)) is not None for p in (r"\p{L}", r"\p{N}", r"\s"))
        self.kind = np.select([letter, number, space], [1, 2, 0], 3).astype(np.uint8)
        self.forget()

    @cached_property
    def slow(self):
        """The tokenizers library's own encoder: loaded only by a worker that meets a text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def cut(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin, for concatenated texts whose code points are all below SAFE."""
        kind = self.kind[points]
        begin = np.empty(len(points), dtype=bool)
        begin[:1] = True
        begin[1:] = kind[1:] != kind[:-1]
        begin[offsets[:-1]] = True
        # The last of a run of white space before something else stands alone, or joins it if it is a plain space.
        last = np.zeros(len(points), dtype=bool)
        last[:-1] = (kind[:-1] == 0) & (kind[1:] != 0)
        last[offsets[1:] - 1] = False
        begin |= last
        joins = np.flatnonzero(last & (points == 32)) + 1
        begin[joins] = False
        return np.flatnonzero(begin)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        from tidemark.llm.textcore import prefix_hash, span_hash

        out: list = [np.zeros(0, dtype=np.uint32)] * len(texts)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        strange = np.flatnonzero((points >= self.SAFE) | (points == 39))
        odd = np.searchsorted(strange, offsets[1:]) > np.searchsorted(strange, offsets[:-1])
        del strange
        for token in self.added:
            odd |= np.fromiter((token in t for t in texts), dtype=bool, count=len(texts))
        for k in np.flatnonzero(odd).tolist():
            out[k] = np.asarray(self.slow.encode(texts[k], add_special_tokens=False).ids, dtype=np.uint32)
        plain = np.flatnonzero(~odd & (sizes > 0))
        if odd.any():
            points = points[np.repeat(~odd, sizes)]
        offsets = np.concatenate([[0], np.cumsum(sizes[plain])])
        if not len(points):
            return out
        starts = self.cut(points, offsets)
        ends = np.append(starts[1:], len(points))
        keys, first, which = np.unique(span_hash(prefix_hash(points), starts, ends), return_index=True, return_inverse=True)
        at, counts = self.lookup(keys, points, starts[first], ends[first])
        each = counts[which]
        upto = np.concatenate([[0], np.cumsum(each)])
        gathered = self.flat[np.repeat(at[which] - upto[:-1], each) + np.arange(upto[-1])]
        edges = upto[np.searchsorted(starts, offsets)].tolist()
        for k, lo, hi in zip(plain.tolist(), edges[:-1], edges[1:], strict=True):
            out[k] = gathered[lo:hi]
        return out

    def lookup(self, keys: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each distinct pre-token stand in ``flat``, and how many they are; new ones are encoded."""
        if len(self.keys) > 500_000:
            self.forget()
        place = np.searchsorted(self.keys, keys)
        new = np.append(self.keys, np.uint64(0))[place] != keys
        new |= place == len(self.keys)
        if new.any():
            lows, highs = starts[new], ends[new]
            spans = np.concatenate([[0], np.cumsum(highs - lows)])
            text = points[np.repeat(lows - spans[:-1], highs - lows) + np.arange(spans[-1])].tobytes().decode("utf-32-le")
            edges, piece = spans.tolist(), self.fast._core_bpe.encode_single_piece
            ids = [piece(text[a:b].encode("utf-8")) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            at = len(self.flat) + np.cumsum(counts) - counts
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(counts.sum()))])
            self.keys, self.at, self.counts = (
                np.insert(old, place[new], more) for old, more in ((self.keys, keys[new]), (self.at, at), (self.counts, counts))
            )
            place = np.searchsorted(self.keys, keys)
        return self.at[place], self.counts[place]

    def forget(self) -> None:
        self.keys, self.at, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, closing: int = 0, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length and either ``ids`` (binary, little-endian uint32) or only their ``ids_crc32``.

    A document's ids end with ``closing``. Only one longer than ``capacity`` is cut, into pieces of ``capacity`` with
    the shorter one first. ``tokenizer`` is the path of a byte-level BPE vocabulary, the same on every machine.
    """
    last = pa.field("ids", pa.binary()) if keep_ids else pa.field("ids_crc32", pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), last])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = keep_only(tokenizer, lambda: FastBytePairs(tokenizer))
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            lengths = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [0, *np.searchsorted(lengths, np.arange(SLICE, lengths[-1] if len(lengths) else 0, SLICE)).tolist(), len(texts)]
            ids_of = batch.column("doc_id")
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi <= lo:
                    continue
                rows: list[list] = [[], [], [], [], []]
                for key, ids in zip(ids_of[lo:hi].to_pylist(), encoder.encode(texts[lo:hi].to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(closing)).astype("<u4")
                    lead = len(ids) % capacity or min(capacity, len(ids))
                    edges = [0, *range(lead, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        raw = ids[a:b].tobytes()
                        for column, value in zip(rows, (key, k, a, b - a, raw if keep_ids else zlib.crc32(raw)), strict=True):
                            column.append(value)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
        give_back()

    ddl = "doc_id long, piece int, start long, length long, " + ("ids binary" if keep_ids else "ids_crc32 long")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, ddl)


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, closing: int = 0, keep_ids: bool = True) -> DataFrame:
    """Pieces with sequence_id and offset: gapless from 0 inside a sequence of at most ``capacity`` ids."""
    spark = docs.sparkSession
    cut = token_pieces(docs, tokenizer, capacity, closing, keep_ids)
    pieces = materialize(cut.withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    # About 100,000 pieces a (length, bucket) at most, copies included: the bucket comes from a piece's written row number.
    total = pieces.count()
    buckets = max(1, total // 100_000)
    payload = "ids" if keep_ids else "ids_crc32"
    marks = ["doc_id", "piece", "start", payload, "_row"]
    bucketed = pieces.withColumn("_b", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    counts = bucketed.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = materialize(counts.withColumn("_begin", F.sum("_n").over(before) - F.col("_n")), "pack-begins")
    histogram = {r["length"]: r["n"] for r in begins.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # <= capacity rows
    runs = plan_packing(histogram, capacity)
    plan = spark.createDataFrame(runs, "length long, _from long, _many long, _bin long, offset long")
    ranked = bucketed.join(F.broadcast(begins.drop("_n")) if buckets == 1 else begins.drop("_n"), ["length", "_b"]).withColumn(
        "_rank", F.col("_begin") + F.row_number().over(Window.partitionBy("length", "_b").orderBy(*marks)) - 1
    )
    # The plan's runs of a length, in rank order, as one array a length: found by a binary-search-free filter on a short list.
    by_length = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_from", "_many", "_bin", "offset"))).alias("_runs"))
    found = ranked.join(F.broadcast(by_length), "length").withColumn(
        "_run", F.filter("_runs", lambda r: (r["_from"] <= F.col("_rank")) & (F.col("_rank") < r["_from"] + r["_many"]))[0]
    )
    return found.select(
        "doc_id", "piece", "start", "length", payload,
        (F.col("_run._bin") + F.col("_rank") - F.col("_run._from")).alias("sequence_id"), F.col("_run.offset").alias("offset"),
    )
