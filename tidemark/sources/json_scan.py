"""JSON sources: security lists of several shapes, run reports as evidence of coverage, server-sent events, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where lists of securities stand in a payload, and the names a ticker goes by.
LIST_KEYS = ["Results", "results", "Profiles", "profiles", "Data", "data", "Replies", "replies"]
NESTED_KEYS = ["Results", "results", "Items", "items", "Data", "data"]
TICKER_KEYS = ["KodeEmiten", "Kode_Emiten", "kodeEmiten", "Ticker", "ticker", "Code", "code", "Symbol", "symbol"]
NOT_A_POLL = ["reduce_cached", "refine_financials"]


def _array(text: Column, path: str) -> Column:
    """The elements, as JSON text, of the array at a path; empty if there is none."""
    found = F.get_json_object(text, path)
    return F.coalesce(F.when(found.startswith("["), F.from_json(found, "array<string>")), F.array().cast("array<string>"))


def ticker_of(row: Column) -> Column:
    """The ticker of one entry (a JSON object, or a bare string), or null: 2 to 8 letters, digits and dashes."""
    names = F.coalesce(*[F.nullif(F.get_json_object(row, f"$.{k}"), F.lit("")) for k in TICKER_KEYS])
    value = F.upper(F.trim(F.when(row.startswith("{"), names).otherwise(row)))
    return F.when(value.rlike("^[A-Z0-9-]{2,8}$") & value.rlike("[A-Z0-9]"), value)


def tickers(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Distinct tickers of payloads: a bare list; lists under known keys, one level of nesting; else an object by ticker."""
    text = F.col(payload)
    lists = F.flatten(F.array(*[_array(text, f"$.{k}") for k in LIST_KEYS], *[_array(text, f"$.{k}.{n}") for k in LIST_KEYS for n in NESTED_KEYS]))
    keyed = F.from_json(text, "map<string,string>")
    own = F.transform(
        F.filter(F.map_entries(keyed), lambda e: e["value"].startswith("{")), lambda e: F.coalesce(F.when(ticker_of(e["value"]).isNotNull(), e["value"]), e["key"])
    )
    rows = F.when(text.startswith("["), F.from_json(text, "array<string>")).when(F.size(lists) > 0, lists).otherwise(F.coalesce(own, F.array().cast("array<string>")))
    return payloads.select(F.explode(rows).alias("row")).select(ticker_of(F.col("row")).alias("ticker")).where("ticker is not null").distinct()


def trusted(listed: int, least: int) -> bool:
    """A security list that is too short is no list."""
    return listed >= least


def report_coverage(reports: DataFrame, scope: str, ticker: str | None = None) -> DataFrame:
    """s, e: the intervals that run reports prove. ``reports`` has the reports' fields as columns.

    A report counts only if it completed and read its source completely, polled at all, had no keyword or cap, and was
    for this ticker and scope (one without a scope only for stocks). Its end is clamped to its poll snapshot; explicit
    ranges win over its own bounds; an incremental one begins just after the watermark it began from.
    """
    blank = lambda c: F.coalesce(F.upper(F.trim(F.col(c))), F.lit(""))
    good = reports.where(
        (F.col("status") == "completed") & F.col("scrape_complete") & ~F.coalesce("metadata_noop", F.lit(False))
        & ~F.coalesce(F.lower(F.trim("mode")).isin(NOT_A_POLL), F.lit(False)) & (blank("keyword_filter") == "") & F.col("max_announcements").isNull()
        & (blank("ticker_filter") == (ticker or "").strip().upper())
        & F.when(blank("scope_key") != "", F.col("scope_key") == scope).otherwise(F.lit(scope.partition(":")[0] == "stocks"))
    ).withColumn("_snap", F.coalesce("metadata_poll_snapshot", "run_started_at"))
    clamp = lambda e: F.when(F.col("_snap").isNotNull(), F.least(e, F.col("_snap"))).otherwise(e)
    given = good.where("metadata_coverage_added is not null").select("_snap", F.explode("metadata_coverage_added").alias("r")).select(F.col("r.start_at").alias("s"), clamp(F.col("r.end_at")).alias("e"))
    start = (
        F.when(F.coalesce(F.lower("metadata_mode"), F.lit("")) != "incremental", F.col("start_at"))
        .when(F.col("watermark_before").isNotNull(), F.greatest(F.col("start_at"), F.expr("watermark_before + interval 1 microsecond")))
        .otherwise(F.coalesce("metadata_effective_start", "start_at"))
    )
    own = good.where("metadata_coverage_added is null").select(start.alias("s"), clamp(F.col("end_at")).alias("e"))
    return given.unionByName(own).where("s is not null and e is not null and e >= s")


def sse_text(lines: DataFrame, stream: str, order: str, line: str = "line") -> DataFrame:
    """The text of each event stream: its ``data:`` lines' deltas in order up to ``[DONE]``, with the last token usage."""
    data = F.when(F.col(line).startswith("data:"), F.trim(F.substring(line, 6, 10_000_000)))
    rows = lines.select(stream, order, data.alias("_d")).where("_d is not null")
    done = rows.where("_d = '[DONE]'").groupBy(stream).agg(F.min(order).alias("_end"))
    live = rows.where("_d <> '[DONE]'").join(done, stream, "left").where(F.col("_end").isNull() | (F.col(order) < F.col("_end")))
    delta = F.coalesce(F.get_json_object("_d", "$.choices[0].delta.content"), F.lit(""))
    used = F.get_json_object("_d", "$.usage.total_tokens").try_cast("int")
    run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, delta.alias("t")))), lambda s: s["t"]), "")
    return live.groupBy(stream).agg(run.alias("text"), F.max_by(used, F.when(used.isNotNull(), F.col(order))).alias("total_tokens"))


def printed(level: Column, stage: Column, message: Column, verbose: bool, cache: bool, network: bool, pages: bool) -> Column:
    """Which events reach the console."""
    quiet = (
        ((stage == "cache") & F.lit(not cache)) | ((stage == "browser") & message.isin("network response", "network request failed") & F.lit(not network))
        | ((stage == "extract") & (message == "PDF page extracted") & F.lit(not pages))
    )
    return level.isin("WARNING", "ERROR") | (F.lit(verbose) & ~quiet)


def export_jsonl(rows: DataFrame, path: str, by: str, order: list[str]) -> None:
    """JSON lines in one folder per key, in order; a key's rows are in one task only as far as its file is."""
    rows.repartition(by).sortWithinPartitions(by, *order).write.partitionBy(by).mode("overwrite").json(path)


def joined_grid(values: DataFrame, formulas: DataFrame) -> DataFrame:
    """Cells (sheet, row, col, value) with the formula where no value is cached."""
    f = formulas.select("sheet", "row", "col", F.col("value").alias("_f"))
    both = values.join(f, ["sheet", "row", "col"], "left")
    shown = F.when(F.col("value").isNull() & F.col("_f").startswith("="), F.concat(F.lit("[FORMULA_NO_CACHED_VALUE: "), F.col("_f"), F.lit("]"))).otherwise(F.col("value"))
    return both.select("sheet", "row", "col", shown.alias("value"))
