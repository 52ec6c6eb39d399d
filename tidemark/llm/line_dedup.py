"""Line dedup: a segment-partition edit join over the corpus' lines.

A line goes if an equal line, or one within the edits allowed to them, stands earlier in the corpus (by doc_id, nulls last,
then hash of the text, then line number). Two lines are allowed a ``rate`` of the longer one's length, at most ``tau``: so
short lines are joined with fewer edits, and those too short for one only exactly. Equal lines are found by two hashes,
128 bits together. For the rest, every distinct line is cut into edits + 1 segments, by the edits allowed at its
length (near a border, by both numbers); two lines within so many edits share a segment of the shorter one, at a
place that the multi-match-aware windows narrow down. So each line adds its segments to an index keyed by (length,
segment number, segment), and probes the index of each length from its own down to tau less with the few substrings
that can match. Keys that join no two different lines are dropped in the same shuffle that brings them together; only
what is left meets the lines themselves. A bucket's index x probe pairs are filtered by length and character bags and
verified by bit-parallel edit distance in a band of 2 edits + 1 diagonals, many pairs at once; they are never rows. A
bucket of many lines is cut into blocks of index lines and of probes, and each pair of blocks is dealt apart.

Lines are compared without the blanks around them. Defined cases: blank lines always stay; null text is empty, with no
line to lose; rows alike in doc_id and text count as one
document and both keep what it keeps; an empty table gives an empty result; other columns are carried along, and the
columns made here replace clashing ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize
from tidemark.llm.textcore import mix, prefix_hash, span_hash

LAST = 2**63 - 1


def within_edits(left: list[np.ndarray], right: list[np.ndarray], tau: int) -> np.ndarray:
    """Whether each pair of strings (arrays of code points) is within ``tau`` edits: banded bit vectors, all pairs in step.

    Bit d of a vector stands for the cell ``tau - d`` below the diagonal; the distance is followed along the lowest
    diagonal and then along the last row.
    """
    n = len(left)
    one = np.fromiter(map(len, left), dtype=np.int64, count=n)
    two = np.fromiter(map(len, right), dtype=np.int64, count=n)
    width, far = 2 * tau + 1, int(max(one.max(initial=0) + tau, two.max(initial=0))) + tau + 1
    a, b = np.full((far + tau, n), 0xFFFFFFFF, dtype=np.uint32), np.full((far, n), 0xFFFFFFFE, dtype=np.uint32)
    for k in range(n):
        a[tau : tau + one[k], k] = left[k]  # row tau + i holds character i: what stands before is no character
        b[: two[k], k] = right[k]
    top = np.uint64(1 << (width - 1))
    full = np.uint64((1 << width) - 1)
    vp = np.full(n, ((1 << (tau + 1)) - 1) << tau, dtype=np.uint64) & full
    vn = np.zeros(n, dtype=np.uint64)
    dist = np.full(n, tau, dtype=np.int64)
    mask = np.full(n, np.uint64(1 << (width - 2)) if width > 1 else np.uint64(0), dtype=np.uint64)
    for i in range(int(two.max(initial=0))):
        eq = np.zeros(n, dtype=np.uint64)
        for d in range(width):  # bit d: character i - tau + d of the left string
            eq |= (a[i + d] == b[i]).astype(np.uint64) << np.uint64(d)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        live, down = i < two, i < one - tau
        dist += (live & down & ((d0 & top) == 0)).astype(np.int64)
        flat = live & ~down
        dist += (flat & ((hp & mask) != 0)).astype(np.int64) - (flat & ((hn & mask) != 0)).astype(np.int64)
        mask = np.where(flat, mask >> np.uint64(1), mask)
        vp = (hn | ~((d0 >> np.uint64(1)) | hp)) & full
        vn = (d0 >> np.uint64(1)) & hp
    return dist <= tau


def segment_starts(length: np.ndarray, tau: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Start and length of each of the tau + 1 segments of lines of the given lengths; the last ones are longer."""
    parts, starts, sizes, at = tau + 1, [], [], np.zeros_like(length)
    for k in range(parts):
        size = length // parts + (k >= parts - length % parts)
        starts.append(at)
        sizes.append(size)
        at = at + size
    return starts, sizes


def segment_keys(points: np.ndarray, offsets: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows, keys, role): role 1 puts a line in the index under a key (and probes it), role 0 only probes."""
    total, length = prefix_hash(points), np.diff(offsets)
    rows = np.arange(len(length))
    for less in range(tau + 1):
        shorter = length - less
        starts, sizes = segment_starts(shorter, tau)
        for k, (start, size) in enumerate(zip(starts, sizes, strict=True)):
            for shift in range(max(-k, less - (tau - k)), min(k, less + (tau - k)) + 1):
                at = start + shift
                fine = (at >= 0) & (at + size <= length) & (size > 0)
                keys = span_hash(total, (offsets[:-1] + at)[fine], (offsets[:-1] + at + size)[fine])
                keys = mix(keys ^ mix(((shorter[fine] * (tau + 1) + k) * 8 + tau).astype(np.uint64) + np.uint64(1)))
                yield rows[fine], keys, int(less == 0 and shift == 0)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, mark, pos and line (trimmed) of every line that isn't blank."""
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn(
        "line", F.trim("line")
    ).where("line <> ''")


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = column.to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))]).astype(np.int64)


def parts(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    from tidemark.llm.textcore import slices

    for lo, hi in slices(batch.column(column), most):
        yield batch.slice(lo, hi - lo)


def allowed(length, tau: int, rate: float):
    """Edits that two lines may differ by, the longer of which has so many characters."""
    return np.minimum(tau, np.floor(length * rate + 1e-9).astype(np.int64))


def near_lines(lines: DataFrame, firsts: DataFrame, tau: int, rate: float, bucket: int, broadcast_rows: int) -> DataFrame:
    """lid of every line within the allowed edits of a different line whose first place is earlier."""
    # For each number of edits, the shortest line that a pair of it can have.
    least = [int(np.ceil(t / rate - 1e-9)) for t in range(1, tau + 2)]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "line"):
                lids, first = np.unique(batch.column("lid").to_numpy(zero_copy_only=False), return_index=True)
                texts = batch.column("line").take(pa.array(first))
                size = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
                keys, owner, role = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
                for edits in range(1, tau + 1):
                    some = np.flatnonzero((size >= least[edits - 1] - edits) & ((size < least[edits]) | (edits == tau)))
                    for rows, key, index in segment_keys(*code_points(texts.take(pa.array(some))), edits):
                        keys.append(key)
                        owner.append(lids[some[rows]])
                        role.append(np.full(len(rows), index, dtype=np.int8))
                yield pa.record_batch(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owner)), pa.array(np.concatenate(role))],
                    names=["key", "lid", "role"],
                )

    long = lines.where(F.length("line") >= least[0] - 1)
    keyed = long.select("lid", "line").mapInArrow(cut, "key long, lid long, role byte")
    same = Window.partitionBy("key")
    live = materialize(
        keyed.withColumns({"_lo": F.min("lid").over(same), "_hi": F.max("lid").over(same), "_ix": F.max("role").over(same)})
        .where("_lo <> _hi and _ix = 1").groupBy("key", "lid").agg(F.max("role").alias("role")),
        "line-keys",
    )
    wanted = materialize(live.select("lid").distinct(), "line-wanted")
    side = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    # Copies of a line collapse in each task before the shuffle.
    texts = long.select("lid", "line").join(side, "lid", "left_semi").groupBy("lid").agg(F.first("line").alias("line"))
    known = materialize(texts.join(firsts.select("lid", "first"), "lid"), "line-texts")
    size = live.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / bucket).cast("long").alias("_s"))
    # Part i x _s + j of a bucket has block i of its index and block j of its probes.
    block, each = F.pmod("lid", F.col("_s")), F.expr("sequence(0L, _s - 1L)")
    spot = lambda salt, role, probes: F.struct(salt.cast("long").alias("salt"), F.lit(role).alias("role"), F.lit(probes).alias("probes"))
    index = F.when(F.col("role") == 1, F.transform(each, lambda j: spot(block * F.col("_s") + j, 1, False))).otherwise(F.array().cast("array<struct<salt:bigint,role:int,probes:boolean>>"))
    probe = F.transform(each, lambda i: spot(i * F.col("_s") + block, 0, True))
    one = F.array(F.struct(F.lit(0).cast("long").alias("salt"), F.col("role").cast("int").alias("role"), F.lit(True).alias("probes")))
    spots = F.explode(F.when(F.col("_s") == 1, one).otherwise(F.concat(index, probe))).alias("_spot")
    dealt = live.join(size, "key").select("key", "lid", spots).select("key", "lid", "_spot.*")
    ready = dealt.join(known, "lid").select("key", "salt", "lid", "role", "probes", "line", "first.k", "first.mark", "first.pos")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        gone: set[int] = set()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key, salt = (held.column(c).to_numpy() for c in ("key", "salt"))
            change = np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1
            if not len(change):
                continue
            done, held = held.slice(0, int(change[-1])), held.slice(int(change[-1]))
            yield report(done, gone)
        if held is not None and len(held):
            yield report(held, gone)

    def report(table: pa.Table, gone: set[int]) -> pa.RecordBatch:
        found = np.unique(decide(table, tau, rate))
        fresh = [x for x in found.tolist() if x not in gone]
        if len(gone) < 1_000_000:  # only spares repeats
            gone.update(fresh)
        return pa.record_batch([pa.array(fresh, pa.int64())], names=["lid"])

    sorted_rows = ready.repartition("key", "salt").sortWithinPartitions("key", "salt", "lid")
    return sorted_rows.mapInArrow(verify, "lid long").distinct()


def decide(table: pa.Table, tau: int, rate: float) -> np.ndarray:
    """lids of the later lines of all verified pairs in whole buckets."""
    key, salt, lid, role, k, mark, pos = (table.column(c).to_numpy() for c in ("key", "salt", "lid", "role", "k", "mark", "pos"))
    probes = table.column("probes").to_numpy()
    points, offsets = code_points(table.column("line").combine_chunks())
    length = np.diff(offsets)
    bags = np.bincount(np.repeat(np.arange(len(lid)) * 32, length) + (points & 31), minlength=32 * len(lid)).reshape(-1, 32).astype(np.int32)
    rank = np.empty(len(lid), dtype=np.int64)
    rank[np.lexsort((pos, mark, k))] = np.arange(len(lid))
    cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1, [len(key)]]).tolist()
    out, left, right, waiting = [np.zeros(0, dtype=np.int64)], [], [], 0

    def settle() -> None:
        a, b = np.concatenate(left), np.concatenate(right)
        pair = np.unique(np.where(lid[a] < lid[b], a, b) * len(lid) + np.where(lid[a] < lid[b], b, a))
        a, b = pair // len(lid), pair % len(lid)
        diff = bags[a] - bags[b]
        edits = allowed(np.maximum(length[a], length[b]), tau, rate)
        good = np.maximum(np.maximum(diff, 0).sum(1), np.maximum(-diff, 0).sum(1)) <= edits
        a, b, edits = a[good], b[good], edits[good]
        for few in range(1, tau + 1):
            measure(a[edits == few], b[edits == few], few)

    def measure(a: np.ndarray, b: np.ndarray, edits: int) -> None:
        order = np.argsort(length[a], kind="stable")
        a, b = a[order], b[order]
        upto = np.cumsum(length[a] + 8) // 2_000_000
        for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))([0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(a)]), strict=True):
            if hi > lo:
                x, y = a[lo:hi], b[lo:hi]
                near = within_edits([points[offsets[i] : offsets[i + 1]] for i in x], [points[offsets[i] : offsets[i + 1]] for i in y], edits)
                out.append(lid[np.where(rank[x] > rank[y], x, y)[near]])

    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        index, probe = np.flatnonzero(role[s:e] == 1) + s, np.flatnonzero(probes[s:e]) + s
        for lo in range(0, len(probe), max(1, 1_000_000 // max(len(index), 1))):
            some = probe[lo : lo + max(1, 1_000_000 // max(len(index), 1))]
            a, b = np.tile(index, len(some)), np.repeat(some, len(index))
            fits = (lid[a] != lid[b]) & (np.abs(length[a] - length[b]) <= allowed(np.maximum(length[a], length[b]), tau, rate))
            if fits.any():
                left.append(a[fits])
                right.append(b[fits])
                waiting += int(fits.sum())
            if waiting > 500_000:
                settle()
                left, right, waiting = [], [], 0
    if left:
        settle()
    return np.concatenate(out)


def line_plan(docs: DataFrame, tau: int = 2, rate: float = 0.1, bucket: int = 2_000, broadcast_rows: int = 2_000_000) -> DataFrame:
    """doc_id, mark (xxhash64 of the text), exact and near: the numbers (from 0) of the lines that go, by reason."""
    lines = _lines(docs).withColumns({"lid": F.xxhash64("line"), "lid2": F.xxhash64(F.lit(1), "line")})
    place = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k"), "mark", "pos")
    firsts = materialize(lines.select("lid", "lid2", place.alias("place")).groupBy("lid", "lid2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "line-firsts")
    near = near_lines(lines, firsts, tau, rate, bucket, broadcast_rows)
    marked = firsts.join(near.withColumn("near", F.lit(True)), "lid", "left")
    verdicts = materialize(marked.where("n > 1 or near").select("lid", "lid2", "first", F.coalesce("near", F.lit(False)).alias("near")), "line-verdicts")
    lost = lines.select("doc_id", "mark", "pos", "lid", "lid2", place.alias("place")).join(verdicts, ["lid", "lid2"]).where("near or place <> first")
    return lost.groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_set(F.when(~F.col("near"), F.col("pos")))).alias("exact"), F.array_sort(F.collect_set(F.when(F.col("near"), F.col("pos")))).alias("near")
    )


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the lines that stay as ``text``, and n_lines, n_exact and n_near (lines that are not blank)."""
    made = ["text", "n_lines", "n_exact", "n_near"]
    plan = line_plan(docs, **options).withColumnRenamed("doc_id", "_id").withColumnRenamed("mark", "_mark")
    # The row as one column: whatever its columns are called, they clash with none of these.
    others = [c for c in docs.columns if c not in made]
    rows = docs.select(F.struct(*others).alias("_row"), F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_m"), F.col("text").alias("_text"))
    joined = rows.join(plan, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_m") == F.col("_mark")), "left")
    lines = F.split("_text", "\n")
    gone = F.array_union(F.coalesce("exact", F.array().cast("array<int>")), F.coalesce("near", F.array().cast("array<int>")))
    kept = F.array_join(F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains(gone, i), x)), lambda x: x.isNotNull()), "\n")
    full = F.size(F.filter(lines, lambda x: F.trim(x) != ""))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    has = F.col("_id").isNotNull() | F.col("_mark").isNotNull()
    whole = F.struct(  # a struct, in which no name is taken for one beside it
        "_row.*", F.when(has, kept).otherwise(F.col("_text")).alias("text"),
        F.when(F.col("_text").isNull(), F.lit(0)).otherwise(full).cast("long").alias("n_lines"),
        F.when(has, count("exact")).otherwise(F.lit(0)).cast("long").alias("n_exact"), F.when(has, count("near")).otherwise(F.lit(0)).cast("long").alias("n_near"),
    )
    return joined.select(whole.alias("_out")).select("_out.*")
