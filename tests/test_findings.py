"""What reviewers found on odd inputs and large tables."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from tidemark.functions.text import lower_each, upper_each
from tidemark.operators import provenance
from tidemark.plans.catalog import ORACLES, QUERIES


def test_case_goes_code_point_by_code_point(spark):
    # Two letters got their capitals in Unicode 16, which DuckDB does not have.
    texts = [chr(n) for n in range(1, 0x1C80) if n not in (0x19B, 0x264)] + [chr(n) for n in range(0x1E00, 0x2000)] + ["straße ßß ﬁ", "ΑΣ Σ", "İxİ", "ᾳŉᾈ", ""]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(texts)], "k int, v string")
    got = sorted(map(tuple, df.select("k", lower_each(F.col("v")), upper_each(F.col("v"))).collect()))
    con = duckdb.connect()
    assert got == [(k, *con.execute("SELECT lower(?), upper(?)", [v, v]).fetchone()) for k, v in enumerate(texts)]


def test_evidence_is_located_past_letters_whose_case_is_longer(spark, tmp_path):
    texts = ["x" * 158 + " fußweg und ﬁn der straße " + "y\n" * 200, "İ" * 120 + "\n" * 38 + " wörter stehen hier ohne zahl " + "z" * 300, "Α" * 158 + " λόγος και ΟΔΟΣ μετά από αυτά " + "z" * 300]
    spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["evidence_locator"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES["evidence_locator"]).fetchall()
    assert sorted(map(tuple, got.select("doc_id", "match", "line", "page").collect())) == sorted(want)
    place = spark.range(1).select(provenance.locate(F.lit("İİİ\nabc"), F.lit("abc")).alias("l")).first().l
    assert (place.match, place.line) == ("exact_text", 2)


def test_files_are_written_and_read_back_by_parts(spark, tmp_path, monkeypatch):
    from tidemark.sources import files

    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "long.txt").otherwise(F.concat(F.lit("s"), F.col("id").cast("string"), F.lit("/a.txt"))).alias("name"), "id", F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    written = files.write_named(rows.repartition(7), str(tmp_path), ["id"])
    want = [f"line {k}" for k in range(3000) if k % 3]
    assert (tmp_path / "long.txt").read_text().splitlines() == want and (tmp_path / "s9" / "a.txt").read_text() == "line 9\n"
    assert written.count() == 1001 and not [p for p in tmp_path.iterdir() if p.name.startswith("_")]
    monkeypatch.setattr(files, "SPAN", 1000)  # many spans of the one file
    got = files.written_lines(written, str(tmp_path), r"long\.txt").orderBy("place").collect()
    assert [r.value for r in got] == want and len({r.place.block for r in got}) > 10
    assert files.written_lines(written, str(tmp_path), r"s\d+/a\.txt").count() == 1000


def test_a_share_has_the_same_lines_as_blocks(spark, tmp_path):
    from tidemark.operators import render

    bundle = spark.createDataFrame([(t, f"2024-0{m}-01", f"2024-0{m}-28", '{"overview": "of %s"}' % t) for t in ("A", "B") for m in (1, 2)], "ticker string, s string, e string, summary string")
    bundle = bundle.select("ticker", F.col("s").cast("timestamp_ntz").alias("start_at"), F.col("e").cast("timestamp_ntz").alias("end_at"), "summary")
    written = render.write_share(bundle, str(tmp_path), ["overview"])
    assert sorted(r.name for r in written.collect()) == ["latest-all-companies.md", "latest-all-companies.txt"]
    for fmt in ("md", "txt"):
        lines = [r.line for r in render.share_lines(bundle, ["overview"], "x", fmt=fmt).orderBy("place").collect()]
        assert (tmp_path / f"latest-all-companies.{fmt}").read_text() == "\n".join(lines) + "\n" and lines[-1].strip() and len(lines) > 20


def test_the_least_alike_pair_is_found_among_all(spark):
    import numpy as np

    from tidemark.llm.ngram_join import least_alike

    same, other = np.arange(20, dtype=np.uint16), np.arange(20, dtype=np.uint16)
    other[:3] = 99  # 17 of 20 alike
    classes = spark.range(200_001).select(F.col("id").alias("a"), F.when(F.col("id") == 77_777, F.lit(other.tobytes())).otherwise(F.lit(same.tobytes())).alias("label"))
    edges = spark.range(1, 200_001).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    assert least_alike(edges, classes, 0.8) == 0.85


def test_near_documents_are_written_without_their_shingles_twice(spark, monkeypatch):
    from tidemark.operators import dedup

    written = []
    monkeypatch.setattr(dedup, "cut", lambda df, tag, real=dedup.cut: written.append((tag, df.columns)) or real(df, tag))
    words = lambda k: " ".join(f"w{(k * 7919 + j * j) % 100_003}" for j in range(200))
    texts = [words(1), words(1), words(1) + " end", words(2), words(2).replace("w", "v", 1), words(3)]
    docs = dedup.fingerprints(spark.createDataFrame([(k, "x", t, ".pdf", f"h{k}") for k, t in enumerate(texts)], "doc_id long, lang string, text string, suffix string, file_hash string"))
    got = {r.doc_id: r.keep for r in dedup.suppress(docs, ["lang"], 0.8, [-F.col("n_tokens"), F.col("doc_id")]).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, 4: False, 5: True}
    columns = dict(written)
    assert not {"text", "tokens", "shingles", "grams", "norm"} & set(columns["dedup-classes"]) and "grams" not in columns["near-docs"]


def test_batches_of_whole_texts_are_small(spark):
    from tidemark.operators import digest
    from tidemark.sources import extract

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for plan in (lambda: digest.chunk(spark.createDataFrame([(1, "a\nb")], "doc_id int, text string"), size=1), lambda: extract.html_text(F.lit("<p>x"))):
        spark.conf.set(key, "10000")
        plan()
        assert 0 < int(spark.conf.get(key)) <= 200


def test_claims_of_odd_documents_are_those_of_the_sql(spark, tmp_path):
    odd = [("0", "en", "s"), ("false", "0", "false"), ("[]", "en", "{}"), (None, None, None), ("", None, "x"), ("İstanbul ve İzmir", "en", "s"), ("stanbul zmir", "en", "s"), ("Kilo ve gram", 'e"n', "s\\")]
    rows = [(k, *odd[k // 12], len(odd[k // 12][0] or "")) for k in range(12 * len(odd))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["claim_traces"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['claim_traces']})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, found))


def test_long_texts_are_compared_by_all_their_shingles(spark, tmp_path):
    words = [f"w{(j * j * 31 + j) % 100_003}x{j % 97}" for j in range(7000)]
    moved = words[:1] + ["new"] + words[1:-1]  # at a stride, none of the n-grams after the second word would be met
    row, more = "a b " * 100, " ".join(f"z{k}" for k in range(10))  # few n-grams: the longer text's own are most of its set
    texts = [" ".join(words), " ".join(moved), " ".join(w if k % 3500 else "other" for k, w in enumerate(words)), row, f"{row}{more}"]
    spark.createDataFrame([(3 * k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("near_dup_pairs", "near_dup_greedy"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 3


def test_all_copies_stand_in_pairs(spark, tmp_path, monkeypatch):
    from tidemark.operators import dedup

    monkeypatch.setattr(dedup, "BLOCK", 3)  # many blocks of few copies
    text = lambda k: " ".join(f"w{(k * 7919 + j * j) % 100_003}" for j in range(130))
    texts = [text(1)] * 11 + [text(1) + " end"] * 7 + [text(2)] + [text(3)] * 2 + [text(2)]
    spark.createDataFrame([(k, t, "en" if k not in (2, 3) else None, "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["near_dup_pairs"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['near_dup_pairs']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 16 * 15 // 2 + 2


def test_staged_parts_need_no_folder_a_name(spark, tmp_path, monkeypatch):
    from tidemark.sources import files

    staged = []
    look = lambda *a, real=files.publish: staged.extend(p.relative_to(tmp_path).parts for p in tmp_path.rglob("*")) or real(*a)
    monkeypatch.setattr(files, "publish", look)
    rows = spark.range(40).select(F.concat(F.lit("c"), (F.col("id") % 20).cast("string"), F.lit("/ä b.txt")).alias("name"), F.col("id").cast("string").alias("line"), "id")
    written = files.write_named(rows, str(tmp_path), ["id"])
    assert {r.name: r["size"] for r in written.collect()} == {p.relative_to(tmp_path).as_posix(): p.stat().st_size for p in tmp_path.rglob("*.txt")}
    assert (tmp_path / "c3" / "ä b.txt").read_text() == "3\n23\n" and max(map(len, staged)) == 3  # the run's folder, a task's, a part


def test_a_share_renders_a_digest_once_for_all_formats(spark, tmp_path, monkeypatch):
    from tidemark.operators import render

    made = []
    monkeypatch.setattr(render, "digest_lines", lambda *a, real=render.digest_lines: made.append(a) or real(*a))
    bundle = spark.createDataFrame([(t, '{"overview": "**of** %s"}' % t) for t in "AB"], "ticker string, summary string").withColumns({c: F.lit("2024-01-01").cast("timestamp_ntz") for c in ("start_at", "end_at")})
    render.write_share(bundle, str(tmp_path), ["overview"], formats=("md", "txt", "json"))
    assert len(made) == 1
    said = {fmt: (tmp_path / f"latest-all-companies.{fmt}").read_text() for fmt in ("md", "txt", "json")}
    assert "## B" in said["md"] and "**of** B" in said["md"] and "\nB\n" in said["txt"] and "\nof B\n" in said["txt"] and '"ticker":"B"' in said["json"]
