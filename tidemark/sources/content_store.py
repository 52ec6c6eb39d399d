"""A content-addressed store: bytes under the SHA-256 of themselves, each kept once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import safe_filename
from tidemark.lineage import cut

STORED = "sha256 string, length long, content binary, prefix string"
#: Bytes that one task writes of a prefix, about.
PART_BYTES = 128 << 20


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """name, sha256, length and content of each file under ``path``; the scan passes over files without a byte."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "length", "content")


class ContentStore:
    """A Parquet table partitioned by the first two digits of the key. Adding what is there writes nothing."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _there(self) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def read(self) -> DataFrame:
        """sha256, length, content and prefix."""
        return self.spark.read.schema(STORED).parquet(self.path) if self._there() else self.spark.createDataFrame([], STORED)

    def add(self, files: DataFrame) -> DataFrame:
        """Store the contents of ``files`` (name, sha256, length, content) that are new; name, sha256, length, path and cache_status
        (``written`` or ``already-exists``) of each file.

        Files are read once for their keys, which alone decide what is new; where something is, contents are read again by the tasks
        that write them, and of several files with one content the first by name is written. A prefix is one task's work, or
        that of several if it is large, so there are few parts to list. A row that two writers add at once stands twice with equal bytes.
        """
        # Shuffled, keys come in few parts; a scan of small files has very many tasks.
        keys = cut(files.select("name", "sha256", "length").repartition("sha256", "name"), "content-files")
        known = self.read().select("sha256").distinct().withColumn("_known", F.lit(True))
        first = keys.groupBy("sha256").agg(F.min("name").alias("_first")).join(known, "sha256", "left")
        told = cut(keys.join(first, "sha256"), "content-keys")
        fresh = told.where("_known is null and name = _first").select("sha256", "name", "length").dropDuplicates(["sha256", "name"])
        size = fresh.agg(F.sum("length")).first()[0]
        if size is not None:
            slots = 1 + int(size) // (256 * PART_BYTES)
            slot = F.pmod(F.xxhash64("sha256"), F.lit(slots)).alias("_slot")
            rows = files.join(fresh.select("sha256", "name"), ["sha256", "name"], "left_semi").select("*", F.substring("sha256", 1, 2).alias("prefix"), slot)
            rows = rows.repartition("prefix", "_slot").dropDuplicates(["prefix", "_slot", "sha256"])
            rows.select("sha256", "length", "content", "prefix").write.mode("append").partitionBy("prefix").parquet(self.path)
        status = F.when(F.col("_known").isNull() & (F.col("name") == F.col("_first")), "written").otherwise("already-exists")
        path = F.concat(F.substring("sha256", 1, 2), F.lit("/"), F.substring("sha256", 1, 12), F.lit("_"), safe_filename(F.col("name")))
        return told.select("name", "sha256", "length", path.alias("path"), status.alias("cache_status"))
