"""Cutting lineage with a written table in the folder that ``spark.checkpoint.dir`` names; batches that workers can hold."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder; on one machine, as in tests, where none is set, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/tidemark"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and read it back: nothing above is computed again, and no lost executor takes it along."""
    path = f"{folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_ROWS = 200


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session at ``BATCH_ROWS`` rows at most: a worker holds a batch of whole texts several times
    over. The caller runs the plan later, so the setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
