"""Tables that cut lineage: Parquet in the folder that ``spark.checkpoint.dir`` names, so every executor sees them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def private(columns: list[str], name: str) -> str:
    """A column name that none of ``columns`` has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only where the setting is absent (tests on one machine) is a local one made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session at ``BATCH_ROWS`` rows at most: a batch of whole texts stands in memory
    several times over, in the JVM and in each Python worker. The caller runs the plan later, so the setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def fresh_path(spark: SparkSession, tag: str) -> str:
    bounded_batches(spark)
    return f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once and read it back: a reliable cut of lineage that outlives any executor."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
