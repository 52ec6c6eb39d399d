"""Operators on hand-made cases."""

from __future__ import annotations

import io
import random
import re
import unicodedata
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import times
from tidemark.operators import coverage, dedup, digest, library, provenance, selection, store, telemetry, triage, validate
from tidemark.operators.attachments import merge_candidates
from tidemark.sources import extract, paged


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_and_subtract(spark):
    cover = spark.createDataFrame([("k", 1, 3), ("k", 5, 6), ("k", 7, 8), ("k", 12, 13), ("k", 6, 6)], "k string, s int, e int")
    assert rows(coverage.merge(cover, ["k"]).select("s", "e")) == [(1, 3), (5, 6), (7, 8), (12, 13)]
    asked = spark.createDataFrame([("k", 2, 10), ("k", 4, 4), ("k", 6, 6), ("k", 5, 8), ("n", 1, 2)], "k string, qs int, qe int")
    gaps = rows(coverage.subtract(asked, cover, ["k"]))
    assert gaps == [("k", 2, 10, 3, 5), ("k", 2, 10, 6, 7), ("k", 2, 10, 8, 10), ("k", 4, 4, 4, 4), ("k", 5, 8, 6, 7), ("n", 1, 2, 1, 2)]


def test_upsert_and_versions(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert rows(store.upsert(old, new, ["id"], ["v"])) == [(1, "a"), (2, "c"), (3, "d")]
    table = store.VersionedStore(spark, f"file://{tmp_path}/t", ["id"])
    assert table.read() is None
    table.merge(old)
    assert rows(table.merge(new)) == [(1, "a"), (2, "c"), (3, "d")] == rows(table.read())
    assert rows(store.update_columns(old, spark.createDataFrame([(1, None)], "id int, v string"), ["id"], ["v"])) == [(1, None), (2, "b")]


def test_selection_ladder(spark):
    cases = [
        (1, 0, "Laporan Keuangan", False, "Checklist A.pdf"), (1, 1, "Laporan Keuangan", False, "LK TW II 2026.pdf"), (1, 2, "Laporan Keuangan", False, "FinancialStatement-1.pdf"),
        (1, 3, "Laporan Keuangan", True, "Tables.XLSX"), (1, 4, "Laporan Keuangan", True, "inline.zip"), (2, 0, "Financial_Statement", True, "FinancialStatement-1.pdf"),
        (2, 1, "Financial_Statement", False, "FinancialStatement-2.pdf"), (3, 0, "Laporan  keuangan", False, "opaque.pdf"), (3, 1, "Laporan  keuangan", True, "other.pdf"),
        (4, 0, "Other", False, "x.exe"), (4, 1, "Other", False, "noext"), (5, 0, "Laporan Keuangan", False, "LK.pdf"), (5, 1, "Laporan Keuangan", False, "more.pdf"),
    ]
    df = spark.createDataFrame(cases, "g int, position int, title string, is_attachment boolean, filename string")
    got = {(r.g, r.position): r.category for r in selection.classify(df, ["g"]).collect()}
    assert got == {
        (1, 0): "administrative", (1, 1): "financial_statement", (1, 2): "financial_statement_duplicate", (1, 3): "financial_statement", (1, 4): "machine_package",
        (2, 0): "financial_statement_duplicate", (2, 1): "financial_statement", (3, 0): "financial_statement", (3, 1): "supporting", (4, 0): "unsupported", (4, 1): "general_source",
        (5, 0): "supporting", (5, 1): "supporting",
    }


def test_triage(spark):
    title, calm = "Laporan Bulanan Registrasi Pemegang Efek", "tidak ada yang berubah pada bulan ini " * 5
    cases = [("calm", title, 1, calm), ("risk", title, 1, calm + "pengambilalihan"), ("sparse", title, 1, "pendek"), ("big", title, 1, "x" * 70_001), ("other", "Lain", 1, calm),
             ("delta", title, 1, calm + "\npemegang 5,10% lalu 5.25 %\npemegang 1% 99%"), ("flat", title, 1, calm + "\npemegang 5,10% lalu 5.15 %"), ("none", title, 1, None)]
    df = spark.createDataFrame(cases, "g string, title string, position int, text string")
    got = {r.g: (r.mode, r.reason, r.signals) for r in triage.triage(df, "g").collect()}
    assert got["calm"] == got["flat"] == ("routine_direct", "clean", [])
    assert got["risk"] == ("full", "material-change", ["control-change"])
    assert got["delta"] == ("full", "material-change", ["ownership-percentage-delta"])
    assert [got[k][1] for k in ("sparse", "big", "other", "none")] == ["sparse-evidence", "large-evidence", "not-routine", "no-evidence"]


def test_greedy_drop_of_a_drop(spark):
    docs = spark.createDataFrame([("g", i, 10 - i) for i in range(4)], "grp string, doc_id long, n_tokens int")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    got = {r.doc_id: (r.keep, r.duplicate_of) for r in dedup.greedy_keep(docs, pairs, ["grp"], [-F.col("n_tokens")]).collect()}
    assert got == {0: (True, None), 1: (False, 0), 2: (True, None), 3: (False, 2)}


def test_suppression_against_a_sequential_rule(spark):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("ab cd ef gh ij kl mn op qr st uv".split()) + str(rnd.randrange(400)) for _ in range(160)) for _ in range(5)]
    rows = []
    for i in range(70):
        words = rnd.choice(base).split()
        if i % 3 == 0:
            words[rnd.randrange(160)] = f"x{i}"
        text = None if i == 69 else "tiny note" if i % 11 == 0 else " ".join(words)
        rows.append((f"a{i % 2}", i, rnd.choice([".pdf", ".xlsx"]), rnd.choice([None, f"h{rnd.randrange(12)}"]), text))
    docs = dedup.fingerprints(spark.createDataFrame(rows, "grp string, doc_id long, suffix string, file_hash string, text string"))
    got = {r.doc_id: (r.keep, r.duplicate_of) for r in dedup.suppress(docs, ["grp"], 0.8, [-F.col("n_tokens"), F.col("doc_id")]).collect()}

    def alike(x, y):
        if x[3] and x[3] == y[3]:
            return True
        a, b = (x[4] or "").split(), (y[4] or "").split()
        if x[2] != y[2] or min(len(a), len(b)) < 120 or min(len(a), len(b)) < 0.94 * max(len(a), len(b)):
            return False
        p, q = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        return len(p & q) / len(p | q) >= 0.8

    want, kept = {}, []
    for row in sorted(rows, key=lambda r: (-len((r[4] or "").split()), r[1])):
        first = next((k[1] for k in kept if k[0] == row[0] and alike(row, k)), None)
        want[row[1]] = (first is None, first)
        kept += [row] if first is None else []
    assert got == want and len(kept) < 40


def test_tokens_are_compatible_forms(spark):
    texts = ["\uff21\uff22\uff11 o\ufb03ce", "re\u0301sume", "caf\u00e9 x", "\u210c2\u00b2", None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    got = {r.k: r.w for r in df.select("k", tx.dedup_tokens(F.col("x")).alias("w")).collect()}
    want = {k: None if x is None else re.findall("[a-z0-9]+", unicodedata.normalize("NFKC", x).lower()) for k, x in enumerate(texts)}
    assert got == want and got[0] == ["ab1", "office"]


def test_fingerprints_tell_nulls_and_bars_apart(spark):
    rows = [("p", 1, "a|b", "c"), ("q", 1, "a", "b|c"), ("r", 1, None, "c"), ("s", 1, "", "c")]
    df = spark.createDataFrame(rows, "g string, k int, x string, y string").withColumn("h", F.lit(1))
    each = [digest.input_fingerprint(df.where(F.col("g") == g), ["h"], ["k"], ["x", "y"], ["m"]).first().fingerprint for g in "pqrs"]
    assert len(set(each)) == 4


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n", max_size=80), st.integers(2, 20))
def test_chunks_are_lossless(text, size):
    ends = digest.cut_points(text, size)
    parts = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    assert "".join(parts) == text and all(len(p) <= size for p in parts)


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "a" * 12), (2, ""), (3, None)], "id int, text string")
    got = {(r.id, r.chunk_index, r.chunk_count, r.chunk) for r in digest.chunk(df, size=5).collect()}
    assert got == {(1, 1, 3, "aaaaa"), (1, 2, 3, "aaaaa"), (1, 3, 3, "aa"), (2, 1, 1, ""), (3, 1, 1, "")}


SCHEMA = {"type": "object", "properties": {"a": {"type": "string", "minLength": 1}, "n": {"type": ["integer", "null"], "minimum": 0}, "k": {"type": "array", "items": {"type": "string", "enum": ["x", "y"]}}},
          "required": ["a", "n"], "additionalProperties": False}


@pytest.mark.parametrize(
    ("value", "error"),
    [({"a": "t", "n": 1}, None), ({"a": "t", "n": None, "k": ["x"]}, None), ({"a": " ", "n": 1}, "$.a: blank"), ({"a": "t"}, "$: missing n"), ({"a": "t", "n": True}, "$.n: type"),
     ({"a": "t", "n": -1}, "$.n: minimum"), ({"a": "t", "n": 1, "z": 0}, "$: unexpected z"), ({"a": "t", "n": 1, "k": ["z"]}, "$.k[0]: enum"), ([], "$: type")],
)
def test_validation(value, error):
    assert validate.first_error(value, SCHEMA) == error


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(tx.normalize_text(F.lit("  a \t b\n\n\n\n\nc\x00 "))) == "a b\n\n\nc"
    assert value(tx.file_suffix(F.lit("dir.x/Report.PDF"))) == ".pdf" and value(tx.file_suffix(F.lit(".hidden"))) == ""
    assert value(tx.percents(F.lit("5,10% and 7 % of 1234%"))) == [5.1, 7.0]
    assert value(tx.render_template(F.lit("{a}-{b}{c}"), F.create_map(F.lit("a"), F.lit("{b}"), F.lit("b"), F.lit("B")))) == "{b}-B"
    assert value(tx.byte_size(F.lit(1536))) == "1.5 KB"
    assert value(times.boundary_label(F.lit("2026-07-01T09:30:00"))) == "2026-07-01 09:30" and value(times.boundary_label(F.lit("2026-07-01T23:59:59"))) == "2026-07-01"
    assert str(value(times.parse_boundary(F.lit("2026-07-01"), end=True))) == "2026-07-01 23:59:59.999999" and value(times.parse_boundary(F.lit("nonsense"))) is None


def test_locate(spark):
    text = "===== PAGE 1 =====\nalpha\n===== PAGE 2 =====\nBeta  gamma delta epsilon zeta"
    df = spark.createDataFrame([(text, "ALPHA"), (text, "beta gamma delta epsilon"), (text, "nowhere at all in this text")], "t string, e string")
    got = [r.l for r in df.select(provenance.locate(F.col("t"), F.col("e")).alias("l")).collect()]
    assert [(x.match, x.line, x.page) for x in got] == [("exact_text", 2, 1), ("normalized_text", None, None), ("not_located", None, None)]


def listed(first, second, columns):
    """The list as a plain fold, a row after the other."""
    out = {}
    for g in {r[0] for r in first + second}:
        merged, urls, names = [], {}, {}
        for source in (first, second):
            for r in sorted((x for x in source if x[0] == g), key=lambda x: x[1]):
                item = dict(zip(columns, r[2:]))
                url, name = (item["url"] or "").strip(), (item["filename"] or "").strip().casefold()
                at = urls.get(url, names.get(name))
                if at is None:
                    at = len(merged)
                    merged.append({c: None for c in columns})
                    urls.update({url: at} if url else {})
                    names.update({name: at} if name else {})
                    merged[at] = dict(item)
                for c, v in item.items():
                    if merged[at][c] in (None, ""):
                        merged[at][c] = v if v not in (None, "") else merged[at][c]
        out[g] = sorted((tuple(m[c] for c in columns) for m in merged), key=str)
    return out


def test_merge_candidates(spark):
    rng, columns = random.Random(4), ["url", "filename", "kind"]
    ddl = "group_id long, pos int, url string, filename string, kind string"

    def made(n):
        urls, names = ["u1", "u2", "u3", " u4", "", None], ["a.pdf", "A.PDF", "b", "c", "Straße", "STRASSE", "", None]
        return [(rng.choice([1, 2, 3, None]), p, rng.choice(urls), rng.choice(names), rng.choice(["x", "", None, "y"])) for p in range(n)]

    first, second = made(60), made(50)
    got = {}
    for r in merge_candidates(spark.createDataFrame(first, ddl).repartition(3), spark.createDataFrame(second, ddl).repartition(3), columns, ["pos"]).collect():
        got.setdefault(r[0], []).append(tuple(r[1:]))
    assert {g: sorted(v, key=str) for g, v in got.items()} == listed(first, second, columns)
    # A url shared by two announcements joins nothing across them.
    a = spark.createDataFrame([(1, 0, "u", "a.pdf", "one"), (2, 0, "u", "b.pdf", None)], ddl)
    b = spark.createDataFrame([(1, 0, "u", "z.pdf", "x"), (2, 0, "u", "a.pdf", "two")], ddl)
    assert rows(merge_candidates(a, b, columns, ["pos"])) == [(1, "u", "a.pdf", "one"), (2, "u", "b.pdf", "two")]
    none = spark.createDataFrame([], ddl)
    assert merge_candidates(none, none, columns, ["pos"]).count() == 0


def test_ewma_in_blocks(spark):
    rng = random.Random(8)
    data = [(g, k, v) for g in ("a", "b", "c", None) for k in range(40) for v in [rng.choice([0.0, -1.0, rng.random() * 9]) if k > 5 else 0.0]] + [("z", 0, 0.0)]
    want = {}
    for g, _, v in data:
        mean, n = want.get(g, (0.0, 0))
        v = max(0.0, v)
        want[g] = (v if mean <= 0 else 0.22 * v + 0.78 * mean, n + 1)
    df = spark.createDataFrame(data, "g string, k int, v double").repartition(3)
    for block in (1, 3, 12):
        got = {r.g: (r.ewma, r.n) for r in telemetry.ewma(df, ["g"], ["k"], "v", block=block).collect()}
        assert got.keys() == want.keys() and all(got[g] == (pytest.approx(want[g][0]), want[g][1]) for g in want)
    assert telemetry.ewma(df.limit(0), ["g"], ["k"], "v").count() == 0


def test_gate_and_peak(spark):
    kinds = ["throttle", "ok", "ok", "ok", "ok", "transient"]
    df = spark.createDataFrame([("p", i, k) for i, k in enumerate(kinds)], "p string, t int, k string")
    r = telemetry.gate_replay(df, ["p"], ["t"], "k", most=4, per_step=2).first()
    assert (r.final_limit, r.throttles, r.transients, r.ramps) == (2, 1, 1, 1)
    spans = spark.createDataFrame([("p", 0, 2), ("p", 1, 3), ("p", 2, 4)], "p string, s int, e int")
    assert telemetry.peak_active(spans, ["p"], "s", "e").first().peak == 2


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_extractors(spark):
    sheet = lambda body: f'<worksheet><sheetData>{body}</sheetData></worksheet>'
    book = _zip({
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="Notes" r:id="a"/><sheet name="Balance Sheet" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<R><x Id="a" Target="worksheets/1.xml"/><x Id="b" Target="worksheets/2.xml"/></R>',
        "xl/sharedStrings.xml": "<sst><si><t>Assets</t></si></sst>",
        "xl/worksheets/1.xml": sheet('<row r="1"><c r="A1"><v>7</v></c></row>'),
        "xl/worksheets/2.xml": sheet('<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><f>A1+1</f></c><c r="D2"/></row><row r="4"><c r="B4"><v>5</v></c></row>'),
    })
    full = extract.xlsx_text(book)
    assert full.index("Balance Sheet") < full.index("Notes") and "ROW 2 | Assets |  | [FORMULA_NO_CACHED_VALUE C2: =A1+1]" in full and "ROW 4 |  | 5" in full
    assert extract.xlsx_text(book, most_cells=4).endswith("priority ordering]") and "ROW 4" not in extract.xlsx_text(book, most_cells=4)
    doc = _zip({"word/document.xml": "<d><body><p><r><t>One</t></r></p><p/><tbl><tr><tc><p><t>a</t></p></tc><tc><p><t>b</t></p></tc></tr></tbl></body></d>"})
    files = spark.createDataFrame([("x.docx", doc), ("p.html", b"<p>Hi<script>no</script><!-- no --></p>"), ("t.txt", b"plain\xff"), ("bad.xlsx", b"zz"), ("z.bin", b"")], "path string, content binary")
    got = {r.path: (r.text, r.error) for r in extract.extract_files(files).collect()}
    assert got["x.docx"] == ("One\na b", None) and got["p.html"] == ("Hi", None) and got["t.txt"] == ("plain�", None)
    assert got["bad.xlsx"][1].startswith("BadZipFile") and got["z.bin"][1] == "unsupported"


def test_ladder_and_wide_page(spark):
    short = spark.createDataFrame([("a", "1", 0, 0, 3)], "id2 string, payload string, page int, place int, reported long")
    whole = spark.createDataFrame([("a", "2", 0, 0, 2), ("b", "3", 0, 1, 2)], "id2 string, payload string, page int, place int, reported long")
    assert paged.ladder([("pagination", short, 1), ("wide-page-probe", whole, 2)])[0] == "wide-page-probe"
    label, all_rows = paged.ladder([("pagination", short, 1), ("date-shards", short, 1)])
    assert label == "date-shards-partial" and rows(all_rows.select("id2", "payload")) == [("a", "1")]
    assert (paged.wide_page(321, 200, 1000, 50), paged.wide_page(10, 200, 1000, 50), paged.wide_page(1001, 200, 1000, 50)) == (321, 200, None)


def test_render(spark):
    from datetime import datetime

    w = spark.createDataFrame([("B", datetime(2026, 1, 1), datetime(2026, 1, 31, 23, 59), "ok"), ("A", datetime(2026, 1, 1), datetime(2026, 1, 31, 12, 0), "fine")], "ticker string, start_at timestamp, end_at timestamp, overview string")
    text = library.render_bundle(w)
    assert text.index("## A") < text.index("## B") and "2026-01-01 → 2026-01-31 12:00" in text and "**Companies:** 2" in text
    assert library.sections(["limitations", "overview"], []) == ["overview", "limitations"]
    with pytest.raises(ValueError, match="unknown"):
        library.sections(["nope"], [])
