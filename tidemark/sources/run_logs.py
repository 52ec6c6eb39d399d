"""What runs leave on disk: state files as a library, event logs as tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.files import numbered_lines

UNFINISHED = ("queued", "running")


def _run_of(file: Column) -> Column:
    return F.element_at(F.split(file, "/"), -2)


def run_library(spark: SparkSession, root: str) -> DataFrame:
    """A row for each ``*/state.json`` under ``root`` that parses, with the time its file was last written (``written_at``).

    Missing or empty values fall back as the log's readers expect: run_id to the folder's name, status to ``unknown``, mode to that
    of the report and then ``scrape``, the number of company summaries to that of the saved ones, last_seq to 0.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "state.json").text(root)
    read = files.select(F.try_parse_json("value").alias("v"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("written_at"))
    get = lambda path, kind="string": F.try_variant_get("v", f"$.{path}", kind)
    text = lambda path: F.nullif(get(path), F.lit(""))
    keys = lambda path: F.coalesce(F.array_sort(F.map_keys(get(path, "map<string,variant>"))), F.array().cast("array<string>"))
    count = lambda path: F.nullif(get(path, "bigint"), F.lit(0).cast("long"))
    return read.where(F.schema_of_variant("v").startswith("OBJECT")).select(
        F.coalesce(text("run_id"), _run_of(F.col("file"))).alias("run_id"), F.coalesce(text("status"), F.lit("unknown")).alias("status"),
        get("created_at").alias("created_at"), get("started_at").alias("started_at"), get("finished_at").alias("finished_at"),
        F.coalesce(text("request.mode"), text("report.mode"), F.lit("scrape")).alias("mode"), get("request.start").alias("start"), get("request.end").alias("end"),
        get("request.ticker").alias("ticker"), F.coalesce(count("report.company_summaries"), F.size(keys("summaries")).cast("long")).alias("company_summaries"),
        get("report.recovery.announcement_summary_count", "bigint").alias("announcement_summaries"), get("failure").alias("failure"),
        F.coalesce(count("last_seq"), F.lit(0).cast("long")).alias("last_seq"), keys("artifact_paths").alias("artifacts"), "file", "written_at",
    )


def reloaded(library: DataFrame, now: Column, keep: int = 20) -> DataFrame:
    """The ``keep`` runs written last, newest first; those that never ended count as interrupted, at ``now`` if no end is told."""
    newest = library.orderBy(F.desc("written_at"), F.desc("file")).limit(keep)
    cut_off = F.col("status").isin(*UNFINISHED)
    return newest.withColumns({
        "finished_at": F.when(cut_off, F.coalesce(F.nullif("finished_at", F.lit("")), now)).otherwise(F.col("finished_at")),
        "failure": F.when(cut_off, F.coalesce(F.nullif("failure", F.lit("")), F.lit("GUI or computer stopped before the run completed"))).otherwise(F.col("failure")),
        "status": F.when(cut_off, "interrupted").otherwise(F.col("status")),
    }).orderBy(F.desc("written_at"), F.desc("file"))


LINE = "seq long, type string, stage string, message string, bad string"


def log_tails(spark: SparkSession, root: str, limit: int = 1000) -> DataFrame:
    """run_id, line (its number, from 1), the event's columns, total (lines of the run's log) and returned (events told): the last
    ``limit`` lines (1 to 5,000) of every ``events.jsonl`` under ``root``, without those that don't parse.

    Only lines' places are ranked and counted; a log whose tail has no good line tells nothing.
    """
    limit = max(1, min(int(limit), 5000))
    lines = numbered_lines(spark, root, "events.jsonl")
    of_file = Window.partitionBy("file")
    total = lines.groupBy("file").agg(F.count(F.lit(1)).alias("total"))
    tail = lines.withColumn("back", F.row_number().over(of_file.orderBy(F.desc("place")))).where(F.col("back") <= limit)
    read = tail.select("file", "back", F.from_json("value", LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}).alias("e")).where("e is not null and e.bad is null")
    told = read.groupBy("file").agg(F.count(F.lit(1)).alias("returned"))
    out = read.join(total, "file").join(told, "file")
    return out.select(_run_of(F.col("file")).alias("run_id"), (F.col("total") - F.col("back") + 1).alias("line"), "e.seq", "e.type", "e.stage", "e.message", "total", "returned")
