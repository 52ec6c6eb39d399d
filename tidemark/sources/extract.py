"""Text of documents: HTML, spreadsheets, word-processor files, plain text and pre-extracted PDF pages."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import file_suffix, normalize_text
from tidemark.lineage import bounded_batches

# Which sheets come first, by terms in their titles or first rows.
TAXONOMY = ["inlinexbrl", "inline xbrl", "token", "hidden", "taxonomy", "schema", "xbrl", "contexts", "units"]
PRIMARY = [
    "statement of financial position", "financial position", "balance sheet", "posisi keuangan", "income statement", "profit or loss",
    "profit and loss", "laba rugi", "pendapatan", "cash flow", "arus kas", "changes in equity", "perubahan ekuitas",
    "statement of comprehensive income", "penghasilan komprehensif",
]
SUPPORTING = ["notes", "catatan", "segment", "segmen", "context"]
LABELS = ["PRIMARY", "GENERAL", "SUPPORTING", "TAXONOMY"]
SILENT = {"script", "style", "template"}
EXTRACTORS = {".pdf": "pdf", ".xlsx": "xlsx", ".xlsm": "xlsx", ".docx": "docx", ".html": "html", ".htm": "html", ".txt": "text", ".csv": "text", ".json": "text", ".xml": "text"}


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent += tag in SILENT

    def handle_endtag(self, tag: str) -> None:
        self.silent -= tag in SILENT and self.silent > 0

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)


def visible_text(html: str | None) -> str:
    parser = _Visible()
    parser.feed(html or "")
    parser.close()
    return "\n".join(parser.parts)


def html_text(html: Column) -> Column:
    """Visible text in Arrow batches, normalised in the JVM."""
    bounded_batches(SparkSession.active())
    visible = F.pandas_udf(lambda texts: texts.map(visible_text), "string")
    return normalize_text(visible(html))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def docx_text(raw: bytes) -> str:
    """Paragraphs that aren't blank, then table rows with their cells joined by tabs."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = next(iter(ElementTree.fromstring(z.read("word/document.xml"))))
    text = lambda node: "".join(x.text or "" for x in node.iter() if _local(x.tag) == "t")
    paragraphs = [text(p) for p in body if _local(p.tag) == "p"]
    rows = ["\t".join("\n".join(text(p) for p in c if _local(p.tag) == "p") for c in r if _local(c.tag) == "tc") for t in body if _local(t.tag) == "tbl" for r in t if _local(r.tag) == "tr"]
    return "\n".join([*(p for p in paragraphs if p.strip()), *rows])


def sheet_priority(title: str, sample: list[str]) -> int:
    """0 primary, 1 general, 2 supporting, 3 taxonomy: by title, else by what the first rows say."""
    name, joined = title.strip().lower(), " | ".join(sample)
    for text, ladder in ((name, ((3, TAXONOMY), (0, PRIMARY), (2, SUPPORTING))), (joined, ((0, PRIMARY), (3, TAXONOMY), (2, SUPPORTING)))):
        for level, terms in ladder:
            if any(t in text for t in terms):
                return level
    return 1


def _cells(raw: bytes) -> list[tuple[str, list[list[str]]]]:
    """(title, grid of texts) of each sheet; a formula without a cached value shows itself."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), next(v for k, v in s.attrib.items() if _local(k) == "id")) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
        out = []
        for title, link in sheets:
            target = links[link].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            grid: list[list[str]] = []
            for row in (r for r in root.iter() if _local(r.tag) == "row"):
                at = int(row.get("r") or len(grid) + 1) - 1
                grid.extend([] for _ in range(at + 1 - len(grid)))
                for cell in row:
                    where = cell.get("r") or ""
                    col = 0
                    for ch in re.match("[A-Z]*", where)[0]:
                        col = col * 26 + ord(ch) - 64
                    col = col - 1 if col else len(grid[at])
                    parts = {_local(x.tag): x for x in cell}
                    value = parts["v"].text if "v" in parts else None
                    if value is not None and cell.get("t") == "s":
                        value = strings[int(value)]
                    elif cell.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
                    elif value is None and "f" in parts:
                        value = f"[FORMULA_NO_CACHED_VALUE {where}: ={parts['f'].text}]"
                    grid[at].extend("" for _ in range(col + 1 - len(grid[at])))
                    grid[at][col] = value or ""
            out.append((title, grid))
    return out


def xlsx_text(raw: bytes, most_cells: int = 250_000) -> str:
    """Sheets by priority and title, rows as ``ROW n | a | b``; the row that would pass the cell budget ends the text."""
    sheets = []
    for title, grid in _cells(raw):
        sample: list[str] = []
        for n, row in enumerate(grid, 1):
            sample += [c.strip().lower() for c in row if c.strip()]
            if n >= 25 or len(sample) >= 80:
                break
        sheets.append((sheet_priority(title, sample), title.strip().lower(), title, grid))
    out, seen = [], 0
    for level, _, title, grid in sorted(sheets, key=lambda s: s[:2]):
        out.append(f"\n\n===== SHEET: {title} =====\nSHEET PRIORITY: {LABELS[level]}")
        for n, row in enumerate(grid, 1):
            filled = [k for k, c in enumerate(row) if c.strip()]
            if not filled:
                continue
            seen += filled[-1] + 1
            if seen > most_cells:
                return "\n".join([*out, "\n[TRUNCATED: spreadsheet cell limit reached after priority ordering]"])
            out.append(f"ROW {n} | " + " | ".join(row[: filled[-1] + 1]))
    return "\n".join(out)


def extractor(name: Column, content_type: Column) -> Column:
    """Which extractor a file needs: by suffix, else by content type, else null."""
    by_suffix = F.create_map(*[F.lit(x) for kv in EXTRACTORS.items() for x in kv])[file_suffix(name)]
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    by_type = F.when(kind.contains("pdf"), "pdf").when(kind.contains("spreadsheet"), "xlsx").when(kind.contains("wordprocessing"), "docx").when(kind.contains("html"), "html").when(kind.startswith("text/"), "text")
    return F.coalesce(by_suffix, by_type)


def extract_files(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """``files`` (binary content) with extractor, text and error: each kind by its own route, in one Arrow pass."""

    @F.pandas_udf("struct<text string, error string>")
    def run(kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
        def one(kind: str | None, raw: bytes) -> tuple[str | None, str | None]:
            try:
                if kind == "xlsx":
                    return xlsx_text(raw), None
                if kind == "docx":
                    return docx_text(raw), None
                if kind == "html":
                    return visible_text(raw.decode("utf-8", "replace")), None
                if kind == "text":
                    return raw.decode("utf-8", "replace"), None
                return None, "unsupported"
            except Exception as e:  # a broken file is a row with an error, not a failed job
                return None, f"{type(e).__name__}: {e}"[:300]

        return pd.DataFrame([one(k, bytes(c)) for k, c in zip(kinds, contents, strict=True)], columns=["text", "error"])

    kind = extractor(F.col(name), F.lit(None).cast("string"))
    return files.withColumn("extractor", kind).withColumn("_x", run("extractor", content)).select(
        *[c for c in files.columns if c != content], "extractor", normalize_text(F.col("_x.text")).alias("text"), F.col("_x.error").alias("error")
    )


def assemble_pages(pages: DataFrame, doc: str = "doc_id", least: int = 80) -> DataFrame:
    """Text of a document from its pages: native text, or the longer of both where it is under ``least`` characters."""
    native, ocr = F.coalesce("native_text", F.lit("")), F.coalesce("ocr_text", F.lit(""))
    use_ocr = (F.length(F.trim(native)) < least) & (F.length(ocr) > F.length(native))
    rows = pages.withColumns({"_ocr": use_ocr, "_t": F.when(use_ocr, ocr).otherwise(native)})
    part = F.concat(F.lit("===== PAGE "), F.col("page_no").cast("string"), F.lit(" =====\n"), F.col("_t"))
    return rows.groupBy(doc).agg(
        normalize_text(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", part.alias("p")))), lambda s: s["p"]), "\n\n")).alias("text"),
        F.when(F.bool_or("_ocr"), "pdf-native+ocr").otherwise("pdf-native").alias("method"),
    )


def within_budget(rows: DataFrame, doc: str, order: list[str], cells: str, most: int) -> DataFrame:
    """Rows up to, not including, the one that passes a running budget."""
    run = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_sum", F.sum(cells).over(run)).where(F.col("_sum") <= most).drop("_sum")
