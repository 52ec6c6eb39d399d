"""The flow end to end on a small feed, and JSON sources."""

from __future__ import annotations

from datetime import datetime as D

from tidemark.plans import flow
from tidemark.sources import json_scan


def test_run_and_repeat(spark):
    cover = spark.createDataFrame([("stocks", D(2026, 1, 1), D(2026, 1, 5), "runtime")], "scope string, s timestamp_ntz, e timestamp_ntz, source string")
    feed = spark.createDataFrame(
        [("a", "AAA", D(2026, 1, 3), "Old"), ("b", "AAA", D(2026, 1, 6), "News"), ("c", "BBB", D(2026, 1, 7), "Laporan Keuangan"), ("d", "ZZZ", D(2026, 1, 8), "Unlisted"), ("e", "AAA", D(2026, 2, 8), "Late"), ("f", "CCC", D(2026, 1, 9), "Empty")],
        "id2 string, ticker string, announced_at timestamp_ntz, title string",
    )
    body = " ".join(f"word{k}" for k in range(200))
    files = spark.createDataFrame(
        [("b", 0, False, "n.txt", "u1", "Hello. There"), ("c", 0, False, "LK TW I.pdf", "u2", body), ("c", 1, True, "laporan keuangan copy.pdf", "u3", body), ("c", 2, True, "Checklist.pdf", "u4", "x")],
        "announcement_id string, position int, is_attachment boolean, filename string, url string, text string",
    )
    none = spark.createDataFrame([], "id2 string")
    saved = spark.createDataFrame([], "ticker string, fingerprint string")
    listed = spark.createDataFrame([("aaa",), ("BBB",), ("CCC",)], "ticker string")
    ask = flow.Request("stocks", D(2026, 1, 1), D(2026, 1, 31), D(2026, 1, 20))
    out = flow.run(ask, cover, lambda gaps: (feed, {"complete": True}), files, none, saved, listed)
    assert [(r.gs, r.ge, r.read_from) for r in out.gaps.collect()] == [(D(2026, 1, 5), D(2026, 1, 20), D(2026, 1, 4))]
    assert {r.id2 for r in out.accepted.collect()} == {"b", "c", "f"}
    assert {r.url for r in out.selected.collect()} == {"u1", "u2"}
    assert {r.ticker: r.action for r in out.companies.collect()} == {"AAA": "promote_single", "BBB": "promote_single", "CCC": "skip_no_evidence"}
    assert [(r.s, r.e) for r in out.coverage.collect()] == [(D(2026, 1, 1), D(2026, 1, 20))]
    again = flow.company_windows(out.accepted, out.digests, out.companies, ask)
    assert {r.ticker: r.action for r in again.collect()} == {"AAA": "cache_hit", "BBB": "cache_hit", "CCC": "skip_no_evidence"}
    partial = flow.commit(ask, cover, out.gaps, complete=False, errors=0)
    assert partial.collect() == cover.collect()
    assert flow.plan_reads(ask, out.coverage).count() == 0


def test_tickers(spark):
    payloads = ['["bbca", "x", 7]', '{"Results": [{"KodeEmiten": " tlkm "}, {"Code": "TOOLONGCODE"}]}', '{"data": {"items": [{"Symbol": "GO-TO"}, {"Symbol": "--"}]}}', '{"ASII": {"name": "n"}, "note": 3}', "broken"]
    df = spark.createDataFrame([(p,) for p in payloads], "payload string")
    assert sorted(r.ticker for r in json_scan.tickers(df).collect()) == ["ASII", "BBCA", "GO-TO", "TLKM"]


def test_report_coverage(spark):
    ddl = ("status string, scrape_complete boolean, metadata_noop boolean, mode string, keyword_filter string, max_announcements int, ticker_filter string, scope_key string, metadata_poll_snapshot timestamp_ntz,"
           "run_started_at timestamp_ntz, metadata_coverage_added array<struct<start_at:timestamp_ntz,end_at:timestamp_ntz>>, start_at timestamp_ntz, end_at timestamp_ntz, metadata_mode string,"
           "watermark_before timestamp_ntz, metadata_effective_start timestamp_ntz")  # fmt: skip
    ok = ("completed", True, None, None, None, None, None, "stocks:all", None, D(2026, 1, 10), None, D(2026, 1, 1), D(2026, 1, 20), "audit", None, None)
    change = lambda **kw: tuple(kw.get(c.split()[0], v) for c, v in zip([x.strip() for x in ddl.replace("array<struct<start_at:timestamp_ntz,end_at:timestamp_ntz>>", "x").split(",")], ok, strict=True))
    rows = [ok, change(status="failed"), change(metadata_noop=True), change(mode="reduce_cached"), change(keyword_filter="k"), change(max_announcements=5), change(ticker_filter="AAA"), change(scope_key="bonds:all"),
            change(metadata_mode="incremental", watermark_before=D(2026, 1, 4)), change(metadata_coverage_added=[(D(2026, 1, 2), D(2026, 1, 3))])]
    got = sorted((r.s, r.e) for r in json_scan.report_coverage(spark.createDataFrame(rows, ddl), "stocks:all").collect())
    assert got == [(D(2026, 1, 1), D(2026, 1, 10)), (D(2026, 1, 2), D(2026, 1, 3)), (D(2026, 1, 4, 0, 0, 0, 1), D(2026, 1, 10))]


def test_sse_and_grid(spark, tmp_path):
    lines = [("s", 0, 'data: {"choices":[{"delta":{"content":"He"}}]}'), ("s", 1, ": ping"), ("s", 2, 'data: {"choices":[{"delta":{"content":"y"}}],"usage":{"total_tokens":9}}'), ("s", 3, "data: [DONE]"), ("s", 4, 'data: {"choices":[{"delta":{"content":"no"}}]}')]
    r = json_scan.sse_text(spark.createDataFrame(lines, "s string, n int, line string"), "s", "n").first()
    assert (r.text, r.total_tokens) == ("Hey", 9)
    v = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, None), ("a", 2, 1, None)], "sheet string, row int, col int, value string")
    f = spark.createDataFrame([("a", 1, 1, "=B1"), ("a", 1, 2, "=A1"), ("a", 2, 1, "5")], "sheet string, row int, col int, value string")
    assert sorted((r.row, r.col, r.value) for r in json_scan.joined_grid(v, f).collect()) == [(1, 1, "x"), (1, 2, "[FORMULA_NO_CACHED_VALUE: =A1]"), (2, 1, None)]
    json_scan.export_jsonl(v, f"file://{tmp_path}/out", "sheet", ["row", "col"])
    assert spark.read.json(f"file://{tmp_path}/out").count() == 3
