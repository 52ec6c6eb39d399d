"""Named files, run logs and the content store: failures, times, broken bytes, empty inputs."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files, run_logs
from tidemark.sources.content_store import ContentStore, scan_files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_named_files_all_or_none(spark, tmp_path):
    lines = [(f"t{k % 3}/a.txt", k, f"line {k} é") for k in range(9)]
    df = spark.createDataFrame(lines, "name string, k int, line string").repartition(4)
    files.write_named(df, str(tmp_path), ["k"])
    assert (tmp_path / "t1" / "a.txt").read_text() == "line 1 é\nline 4 é\nline 7 é\n"
    files.write_named(df.where("name = 't0/a.txt'").withColumn("line", F.lit("new")), str(tmp_path), ["k"])  # replaced at once
    assert (tmp_path / "t0" / "a.txt").read_text() == "new\n" * 3 and (tmp_path / "t1" / "a.txt").exists()

    broken = df.withColumn("line", F.when(F.col("k") == 7, F.raise_error(F.lit("no"))).otherwise(F.lit("partial")))
    with pytest.raises(Exception):
        files.write_named(broken, str(tmp_path), ["k"])
    assert sorted(os.listdir(tmp_path)) == ["t0", "t1", "t2"] and "partial" not in "".join(p.read_text() for p in tmp_path.glob("*/a.txt"))
    for name in ("../out.txt", "", "a//b", "_staging-x/a"):
        with pytest.raises(Exception):
            files.write_named(spark.createDataFrame([(name, 0, "x")], "name string, k int, line string"), str(tmp_path), ["k"])
    assert sorted(os.listdir(tmp_path)) == ["t0", "t1", "t2"]
    files.write_named(df.limit(0), str(tmp_path), ["k"])


def test_library_is_newest_first(spark, tmp_path):
    for k in range(25):
        (tmp_path / f"r{k}").mkdir()
        state = {"run_id": f"run{k}", "status": "running" if k % 2 else "completed", "finished_at": "then", "summaries": {"A": 1}, "last_seq": "7" if k == 24 else k, "failure": None}
        path = tmp_path / f"r{k}" / "state.json"
        path.write_text(json.dumps(state))
        os.utime(path, (1_700_000_000 + (k * 7) % 25, 1_700_000_000 + (k * 7) % 25))
    for name, text in (("bad", "{"), ("list", "[1]"), ("none", "")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "state.json").write_text(text)
    library = run_logs.run_library(spark, str(tmp_path))
    assert library.count() == 25
    kept = run_logs.reloaded(library, F.lit("now")).collect()
    want = sorted(range(25), key=lambda k: -((k * 7) % 25))[:20]
    assert [r.run_id for r in kept] == [f"run{k}" for k in want]
    assert all((r.status, r.finished_at) == (("interrupted", "then") if k % 2 else ("completed", "then")) and r.company_summaries == 1 for r, k in zip(kept, want))
    assert all((r.failure is not None) == (k % 2 == 1) for r, k in zip(kept, want))


def test_log_tails_of_long_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    n = 40_000
    text = "\n".join("{broken" if k % 1000 == 999 else json.dumps({"seq": k, "type": "event", "message": "m" * 20}) for k in range(n))
    (tmp_path / "a" / "events.jsonl").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        got = run_logs.log_tails(spark, str(tmp_path), limit=3000).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.seq for r in got) == [k for k in range(n - 3000, n) if k % 1000 != 999] and {(r.total, r.returned) for r in got} == {(n, 2997)}
    assert all(r.line == r.seq + 1 for r in got)
    assert len(run_logs.log_tails(spark, str(tmp_path), limit=0).collect()) == 0  # one line, and that is broken


def test_content_store_keeps_bytes_once(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for name, data in (("a.bin", b"\x00\xff"), ("b.bin", b"\x00\xff"), ("c.bin", b""), ("d?.bin", b"d")):
        (raw / name).write_bytes(data)
    store = ContentStore(spark, f"file://{tmp_path}/store")
    told = {r.name: r for r in store.add(scan_files(spark, str(raw))).collect()}
    assert {n: r.cache_status for n, r in told.items()} == {"a.bin": "written", "b.bin": "already-exists", "d?.bin": "written"}  # c.bin has no bytes
    assert told["d?.bin"].path.endswith("_d_.bin") and sorted(r.content for r in store.read().collect()) == [b"\x00\xff", b"d"]
    (raw / "e.bin").write_bytes(b"e")
    assert {r.name: r.cache_status for r in store.add(scan_files(spark, str(raw))).collect()} == {n: "written" if n == "e.bin" else "already-exists" for n in ("a.bin", "b.bin", "d?.bin", "e.bin")}
    assert store.read().count() == 3
