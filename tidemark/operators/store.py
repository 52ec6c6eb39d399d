"""Keyed stores on Parquet: upserts by rank and rewrite, partial updates by join, deletes by anti-join.

A store is a folder of versions; a write makes a new version and then moves the pointer, so readers never see half.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order``."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """Last write wins on every column: a new row replaces the old one; of several new rows the first in ``order``."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(rows, keys, [F.desc("_new"), *(order or [])]).drop("_new")


def update_columns(old: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Only ``columns`` of the rows that ``changes`` names; everything else stays."""
    new = changes.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = old.join(new, keys, "left")
    kept = [F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns]
    return joined.select(*kept)


def changed(old: DataFrame, new: DataFrame, keys: list[str], flag: str, group: list[str]) -> DataFrame:
    """For each group: did any existing row's flag change?"""
    both = new.alias("n").join(old.select(*keys, F.col(flag).alias("_was")), keys, "left")
    differs = F.col("_was").isNotNull() & (F.col("_was") != F.col(flag))
    return both.groupBy(*group).agg(F.bool_or(differs).alias("selection_changed"))


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def with_defaults(rows: DataFrame, schema: dict[str, tuple[str, object]]) -> DataFrame:
    """Additive migration: columns that are missing, or null, get their type and default."""
    for name, (kind, default) in schema.items():
        value = F.lit(default).cast(kind)
        rows = rows.withColumn(name, F.coalesce(F.col(name).cast(kind), value) if name in rows.columns else value)
    return rows


def valid_cache(rows: DataFrame, model: str | None = None, prompt: str | None = None) -> DataFrame:
    """Cached rows of the wanted lineage; a check left out accepts all. A filter: reading never deletes."""
    if model is not None:
        rows = rows.where(F.col("model") == model)
    return rows.where(F.col("prompt_version") == prompt) if prompt is not None else rows


class VersionedStore:
    """A table as a folder of Parquet versions with a pointer, written last: a line a version, with the batch it came from."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _last(self) -> tuple[int, str, int] | None:
        """Number, version and batch (-1: none) of the newest line."""
        pointer = f"{self.path}/_current"
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(pointer)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return None
        newest = self.spark.read.text(pointer).orderBy(F.desc("value")).first()
        if newest is None:  # a write that ended before its line
            return None
        number, version, *batch = newest[0].split(" ")
        return int(number), version, int(batch[0]) if batch else -1

    def read(self) -> DataFrame | None:
        last = self._last()
        return self.spark.read.parquet(f"{self.path}/{last[1]}") if last else None

    def merge(self, new: DataFrame, order: list | None = None, batch: int | None = None) -> DataFrame | None:
        """Upsert ``new``; of several rows of a key the first in ``order`` stays. With ``batch``, the number of a stream's batch: one
        that has been merged already is passed over."""
        last = self._last()
        if batch is not None and last is not None and batch <= last[2]:
            return self.read()
        old = self.read()
        rows = latest_per_key(new, self.keys, order or [F.lit(1)]) if old is None else upsert(old, new, self.keys, order)
        version = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{version}")
        line = f"{last[0] + 1 if last else 0:012d} {version} {(last[2] if last else -1) if batch is None else batch}"
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/_current")
        return self.read()
