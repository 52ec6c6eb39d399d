"""What both vector operators share: which vectors take part, classes of equal ones, and shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize


def usable(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that take part, the rest), with uid, vec_id and v (array of double): out are vectors that are null, empty, zero
    or hold null or non-finite components, and those not of the table's usual dimension (of equals, the smallest). All rows
    get their uid in one written table, so it names the same row wherever it is read."""
    fine = F.coalesce(
        (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    tagged = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("uid", F.monotonically_increasing_id())
    rows = materialize(tagged.withColumn("_fine", fine), "vectors")
    sizes = sorted((-r["n"], r["d"]) for r in rows.where("_fine").groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
    part = F.col("_fine") & (F.coalesce(F.size("v"), F.lit(-1)) == (sizes[0][1] if sizes else 0))
    return rows.where(part).drop("_fine"), rows.where(~part).drop("_fine")


def classes(rows: DataFrame, members: int = 0) -> DataFrame:
    """cid, v, n (copies) and ids (the ``members`` smallest vec_ids) of each class of equal vectors.

    Copies are counted and thinned in salted groups first, so one very common vector is not one task's work.
    """
    keyed = rows.withColumn("_salt", F.pmod(F.xxhash64("uid"), F.lit(64)))
    if members:
        first = Window.partitionBy("v", "_salt").orderBy("vec_id", "uid")
        some = keyed.withColumn("_k", F.row_number().over(first))
        part = some.groupBy("v", "_salt").agg(
            F.min("uid").alias("cid"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("_k") <= members, F.col("vec_id")))).alias("ids")
        )
        return part.groupBy("v").agg(F.min("cid").alias("cid"), F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, members).alias("ids"))
    return keyed.groupBy("v").agg(F.min("uid").alias("cid"), F.count(F.lit(1)).alias("n"))


def sharded(rows: DataFrame, shard_rows: int, least: int) -> tuple[DataFrame, int]:
    """``rows`` with ``shard``, a hash of cid: at least ``least`` shards, of about ``shard_rows`` at most."""
    shards = max(least, -(-rows.count() // shard_rows))
    return rows.withColumn("shard", F.pmod(F.xxhash64("cid"), F.lit(shards)).cast("int")), shards


def stack(column) -> np.ndarray:
    """A pandas column of equal-length lists as a matrix."""
    return np.array(column.tolist(), dtype=np.float64) if len(column) else np.zeros((0, 1))


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows at length one in single precision; scaled by the largest component first, so that squares stay finite."""
    matrix = matrix / np.maximum(np.abs(matrix).max(axis=1, keepdims=True), 1e-300)
    return (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)).astype(np.float32)
