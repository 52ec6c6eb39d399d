"""Repair of conversation structure: cheapest edits that make the roles of a conversation match ``(s?(ua)+)?``.

Turns are put in order by a range partitioning and get an id that follows it; what the search needs of a turn (initial of
its role, fault) is dealt by hash of conversation and block of ``BLOCK`` ids. Inside each batch of such blocks a recursive
DuckDB query advances one turn at a time for all blocks at once and keeps, for each grammar state at the block's start and
each state reached, the least cost and its audit. Blocks are then chained, ``FAN`` at a time, by the same query, so that
neither search nor memory grows with the longest conversation. Of two equally cheap audits in the same state neither is
a prefix of the other (a longer one would hold more insertions, which cost), so keeping the ASCII-least is safe.

Edits: K keep (0), R give the role user or assistant (2), D delete (3; blank and repeated turns must go), I insert an empty
turn of user or assistant (2); a truncated turn that stays adds 1. Only the digest of a repaired conversation is sequential:
its turns stream through one task in order.

Defined cases: a null role or text is one space; a null conv_id is a conversation; turns go by turn (nulls first), then role,
then text; no turns: no row (``repairs_of`` gives zeros for the ids it is asked for); a text of white space (``\\x20\\x09-\\x0D``)
is blank; a role and text seen earlier in the conversation is a repeat, whatever the fault of the earlier; of several faults the
first of blank, duplicate, truncated counts; gaps beyond a long are null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize

#: Turns of one conversation that one search takes, and blocks chained at a time, as powers of two.
BLOCK, FAN = 8, 6
#: Rows of blocks that stand in DuckDB at a time.
BATCH = 20_000
WHITE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Grammar states: nothing yet, after a system turn, after a user turn, after an assistant turn. What may follow each.
FOLLOWS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
#: The state after one inserted turn, and what closes a conversation in each state: letters.
INSERTED = {0: 2, 1: 2, 2: 3, 3: 2}
CLOSING = {0: "", 1: "II", 2: "I", 3: ""}


def moves() -> list[tuple[int, str | None, int, str, int]]:
    """(state, initial that the turn must have or None, new state, letters, cost) of every way to take one turn. A deletion
    needs no insertion before it: after it, the same letters come ASCII-first."""
    found = []
    for state in FOLLOWS:
        at, letters = state, ""
        for _ in range(3):
            cost = 2 * len(letters)
            found += [(state, initial, new, letters + "K", cost) for initial, new in FOLLOWS[at].items()]
            found.append((state, None, INSERTED[at], letters + "R", cost + 2))
            at, letters = INSERTED[at], letters + "I"
        found.append((state, None, state, "D", 3))
    return found


TAKE = f"""
SELECT t.seg, t.i, m.state AS entry, m.new AS state,
       min({{'cost': m.cost + CASE WHEN t.fault = {TRUNCATED} AND m.letters <> 'D' THEN 1 ELSE 0 END, 'audit': m.letters}}) AS best
FROM turns t JOIN moves m ON (m.initial IS NULL OR m.initial = t.first) AND (t.fault NOT IN ({BLANK}, {DUPLICATE}) OR m.letters = 'D')
GROUP BY ALL"""
CHAIN = """
WITH RECURSIVE run(seg, entry, state, i, best) USING KEY (seg, entry, state) AS (
  SELECT seg, e, e, 0::BIGINT, {'cost': 0::BIGINT, 'audit': ''} FROM (SELECT DISTINCT seg FROM parts), (VALUES (0), (1), (2), (3)) v(e)
  UNION
  SELECT r.seg, r.entry, p.state, p.i, min({'cost': r.best.cost + p.best.cost, 'audit': r.best.audit || p.best.audit})
  FROM run r JOIN parts p ON p.seg = r.seg AND p.i = r.i + 1 AND p.entry = r.state GROUP BY ALL),
ends AS (
  SELECT seg, max(i) AS n, arg_min(first, i) AS first, arg_max(last, i) AS last,
         sum(illegal + CASE WHEN prev || first NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END)::BIGINT AS illegal
  FROM (SELECT *, lag(last) OVER (PARTITION BY seg ORDER BY i) AS prev FROM edges) GROUP BY seg)
SELECT r.seg, r.entry, r.state, r.best.cost AS cost, r.best.audit AS audit, e.first, e.last, e.illegal
FROM run r JOIN ends e ON e.seg = r.seg AND e.n = r.i"""


def whole_segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about ``BATCH`` rows with ``seg``, a number for each (k, g); rows of one (k, g) come together and stay so."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += len(batch)
        if rows < BATCH:
            continue
        table = pa.concat_tables(held).combine_chunks()
        starts = np.flatnonzero(_changes(table))
        if len(starts) > 1:
            yield _numbered(table.slice(0, starts[-1]))
            table = table.slice(starts[-1])
        held, rows = [table], len(table)
    if rows:
        yield _numbered(pa.concat_tables(held).combine_chunks())


def _changes(table: pa.Table) -> np.ndarray:
    k, g = table["k"].to_numpy(), table["g"].to_numpy()
    return np.concatenate([[True], (k[1:] != k[:-1]) | (g[1:] != g[:-1])])


def _numbered(table: pa.Table) -> pa.Table:
    return table.append_column("seg", pa.array(np.cumsum(_changes(table)) - 1))


OUT = "k string, g long, entry int, state int, cost long, audit string, first string, last string, illegal long"


def _search(level_zero: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": "1"})
        con.execute("CREATE TABLE moves(state INT, initial VARCHAR, new INT, letters VARCHAR, cost BIGINT)")
        con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?)", moves())
        for table in whole_segments(batches):
            keys = table.filter(pa.array(_changes(table))).select(["seg", "k", "g"])
            con.register("rows", table)
            con.register("keys", keys)
            if level_zero:
                con.execute("CREATE OR REPLACE TEMP TABLE turns AS SELECT seg, row_number() OVER (PARTITION BY seg ORDER BY id) AS i, initial AS first, fault FROM rows")
                con.execute("CREATE OR REPLACE TEMP TABLE edges AS SELECT seg, i, first, first AS last, 0 AS illegal FROM turns")
                con.execute(f"CREATE OR REPLACE TEMP TABLE parts AS {TAKE}")
            else:
                con.execute("CREATE OR REPLACE TEMP TABLE numbered AS SELECT *, dense_rank() OVER (PARTITION BY seg ORDER BY block) AS i FROM rows")
                con.execute("CREATE OR REPLACE TEMP TABLE edges AS SELECT DISTINCT seg, i, first, last, illegal FROM numbered")
                con.execute("CREATE OR REPLACE TEMP TABLE parts AS SELECT seg, i, entry, state, {'cost': cost, 'audit': audit} AS best FROM numbered")
            found = con.execute(f"SELECT k, g, entry, state, cost, audit, first, last, illegal FROM ({CHAIN}) JOIN keys USING (seg)")
            yield from found.to_arrow_table().cast(_arrow(OUT)).to_batches()

    return run


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with the faults that crc32 of ``conv_id:turn`` names planted in them."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def key(column: str = "conv_id"):
    """A conversation's name for joins: no null, and no other id's."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def ordered(turns: DataFrame) -> DataFrame:
    """Written turns with ``k`` and ``id``, which rises through all conversations in order. Long ones span partitions."""
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return materialize(dealt.withColumns({"id": F.monotonically_increasing_id(), "k": key()}), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """k, conv_id, turn, id, initial and fault of each row of ``turns`` (of ``ordered``); no texts. Repeats are found by a
    digest of role and text, whose least id combines before the shuffle."""
    end = F.rtrim("text", F.lit(WHITE))
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    slim = turns.select("k", "conv_id", "turn", "id", F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"),
                        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"), same.alias("same"))
    first = slim.groupBy("k", "same").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    fault = F.when(F.col("blank"), BLANK).when(F.col("id") > F.col("first"), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(0)
    return slim.join(first, ["k", "same"], "left").select("k", "conv_id", "turn", "id", "initial", fault.alias("fault"))


def cheapest(slim: DataFrame) -> DataFrame:
    """k, cost, audit and illegal (adjacent initials that no conversation has) of each conversation of ``faults``' rows."""
    blocks = slim.select("k", F.shiftright("id", BLOCK).alias("g"), "id", "initial", "fault").repartition("k", "g").sortWithinPartitions("g", "k", "id")
    parts = materialize(blocks.mapInArrow(_search(True), OUT), "repairs")
    done = []
    while True:
        spread = parts.groupBy("k").agg((F.min("g") == F.max("g")).alias("one"))
        marked = materialize(parts.join(spread, "k"), "repairs")
        done.append(marked.where("one"))
        rest = marked.where("not one")
        if rest.isEmpty():
            break
        grouped = rest.withColumnRenamed("g", "block").withColumn("g", F.shiftright("block", FAN)).repartition("k", "g").sortWithinPartitions("g", "k", "block")
        parts = materialize(grouped.select("k", "g", "block", "entry", "state", "cost", "audit", "first", "last", "illegal").mapInArrow(_search(False), OUT), "repairs")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    close = F.element_at(F.array(*[F.lit(x) for x in CLOSING.values()]), F.col("state") + 1)
    closed = every.where("entry = 0").select("k", "illegal", F.struct((F.col("cost") + 2 * F.length(close)).alias("cost"), F.concat("audit", close).alias("audit")).alias("best"))
    return closed.groupBy("k").agg(F.min("best").alias("best"), F.max("illegal").alias("illegal")).select("k", "best.cost", "best.audit", "illegal")


def mended(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, str | None, str, str]]:
    """(k, edit, role, text) in order, for rows sorted by k and id whose first of each k holds the audit; deleted turns too.
    The audit's end is told by an edit None."""
    name, audit, at, state = None, "", 0, 0

    def insertions():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, INSERTED[state]
            yield name, "I", "assistant" if state == 3 else "user", ""

    for batch in batches:
        columns = [batch.column(c) for c in ("k", "audit", "role", "text")]
        for row in range(len(batch)):
            k, letters, role, text = (c[row].as_py() for c in columns)
            if letters is not None:
                if name is not None:
                    yield from insertions()
                    yield name, None, "", ""
                name, audit, at, state = k, letters, 0, 0
                continue
            yield from insertions()
            edit, at = audit[at], at + 1
            if edit == "R":
                state = INSERTED[state]
                role = "assistant" if state == 3 else "user"
            elif edit == "K":
                state = FOLLOWS[state][role[0]]
            yield name, edit, role, text
    if name is not None:
        yield from insertions()
        yield name, None, "", ""


def _by_conversation(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    none = lambda c: F.lit(None).cast("string").alias(c)
    audits = repairs.select("k", F.lit(-1).cast("long").alias("id"), "audit", none("role"), none("text"))
    return audits.unionByName(turns.select("k", "id", none("audit"), "role", "text")).repartition("k").sortWithinPartitions("k", "id")


def repaired_turns(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """k, place (from 0), edit, role and text of the repaired conversations; ``turns`` of ``ordered``, ``repairs`` of ``cheapest``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place = [], 0
        for k, edit, role, text in mended(batches):
            if edit is None:
                place = 0
            elif edit != "D":
                out.append((k, place, edit, role, text))
                place += 1
            if len(out) >= 1_000:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=["k", "place", "edit", "role", "text"])
                out = []
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=["k", "place", "edit", "role", "text"])

    return _by_conversation(turns, repairs).mapInArrow(run, "k string, place long, edit string, role string, text string")


def digests(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """k and repaired_sha256, of the repaired ``role:text`` joined by newlines: streamed in order, a turn at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, whole, any_yet = [], hashlib.sha256(), False
        for k, edit, role, text in mended(batches):
            if edit is None:
                out.append((k, whole.hexdigest()))
                whole, any_yet = hashlib.sha256(), False
            elif edit != "D":
                whole.update((("\n" if any_yet else "") + f"{role}:{text}").encode())
                any_yet = True
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=["k", "repaired_sha256"])

    return _by_conversation(turns, repairs).mapInArrow(run, "k string, repaired_sha256 string")


def repairs_of(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row for each conversation of ``ids`` (conv_id; by default those of ``turns``): conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256."""
    rows = ordered(turns)
    slim = materialize(faults(rows), "faults")
    repairs = materialize(cheapest(slim), "audits")
    spans = slim.groupBy("k", "turn").agg(*[F.count_if(F.col("fault") == f).alias(f"f{f}") for f in (BLANK, DUPLICATE, TRUNCATED)])
    exact = lambda c: c.cast("decimal(38,0)")
    gaps = F.coalesce(exact(F.max("turn")) - exact(F.min("turn")) + 1 - exact(F.count("turn")), F.lit(0))
    counts = spans.groupBy("k").agg(
        gaps.try_cast("long").alias("gaps"), F.sum(f"f{BLANK}").alias("blank"), F.sum(f"f{DUPLICATE}").alias("duplicate"), F.sum(f"f{TRUNCATED}").alias("truncated")
    )
    known = (turns if ids is None else ids).select("conv_id").distinct().withColumn("k", key())
    found = known.join(counts.withColumn("there", F.lit(True)), "k", "left").join(repairs, "k", "left").join(digests(rows, repairs), "k", "left")
    longs = [F.when(F.col("there"), F.col(c)).otherwise(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(
        "conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    )
