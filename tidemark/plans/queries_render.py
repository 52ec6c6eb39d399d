"""Digests of all documents rendered section by section, and shares as files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.lineage import folder
from tidemark.operators import render
from tidemark.operators.library import SECTIONS
from tidemark.plans.registry import WINDOWS_SQL, query, windows
from tidemark.sources import files

_W = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_N = "chr(10)"


def _section(label: str, *items: str) -> str:
    return " || ".join([f"'### {label}' || {_N} || {_N}", *[f"{x} || {_N}" for x in items], _N])


_BEFORE = " || ".join([
    f"CASE WHEN doc_id % 3 <> 0 THEN '**Announcements:** ' || n_chars || {_N} || {_N} ELSE '' END",
    f"CASE WHEN x = '' THEN '' ELSE '### Overview' || {_N} || {_N} || x || {_N} || {_N} END",
    _section("Timeline", "CASE WHEN doc_id % 2 = 1 THEN '- **' || s || '**' WHEN x = '' THEN '- **' || l || ' · ' || s || '**' ELSE '- **' || l || ' · ' || s || ':** ' || x END"),
    _section("Material changes", "'- ' || l", "'- ' || doc_id"),
    _section("Key financial figures", "'- **' || l || ':** ' || n_chars || ' (' || s || ')'", "'- **Figure:** v'"),
    _section("Corporate actions", """'- `{"a": "' || l || '", "b": ' || doc_id || '}`'""", "'- plain'"),
    f"'### Expansion projects' || {_N} || {_N}",
])
_CODE = f"""'{{' || {_N} || '  "k": "' || l || '"' || {_N} || '}}' || {_N}"""
_AFTER = " || ".join([
    _N, f"'### Management / control changes' || {_N} || {_N} || s || {_N} || {_N}", f"'### Listing / regulatory' || {_N} || {_N} || 'True' || {_N} || {_N}",
    _section("Analytical scenarios", f"rtrim('- **' || l || '** [c, high]: ' || x, {_W})", "'  - Basis: b1; b2'", "'  - Caveats: ' || s", "'- **Scenario**: alone'"),
    f"'### Risks / uncertainties' || {_N} || {_N} || doc_id || {_N} || {_N}", _section("Items to monitor", "'- # not a heading'", "'- **bold** `code`'"),
])
_PLAIN = f"""array_to_string(list_transform(string_split({{0}}, {_N}), lambda q: regexp_replace(replace(replace(CASE WHEN starts_with(q, '### ') THEN substr(q, 5) WHEN starts_with(q, '## ') THEN upper(substr(q, 4)) WHEN starts_with(q, '# ') THEN upper(substr(q, 3)) ELSE q END, '**', ''), chr(96), ''), '^> ', '')), {_N})"""


@query(f"""WITH d AS (SELECT doc_id, n_chars, trim(coalesce(text, ''), {_W}) AS x, coalesce(nullif(lang, ''), 'xx') AS l, coalesce(nullif(source, ''), 'xx') AS s FROM documents),
r AS (SELECT doc_id, {_BEFORE} AS before, {_CODE} AS code, {_AFTER} AS after FROM d)
SELECT doc_id, md5(left(m, length(m) - 1)) AS markdown, md5(left(p, length(p) - 1)) AS text FROM (SELECT doc_id, before || '```json' || {_N} || code || '```' || {_N} || after AS m, {_PLAIN.format("before")} || code || {_PLAIN.format("after")} AS p FROM r)""")
def digest_sections(t, spark, sf):
    """All thirteen sections of a digest, as Markdown and as text, in every shape that a section can have"""
    d = t("documents").select("doc_id", "n_chars", F.coalesce("text", F.lit("")).alias("x"), *[F.coalesce(F.nullif(c, F.lit("")), F.lit("xx")).alias(a) for c, a in (("lang", "l"), ("source", "s"))])
    even = F.col("doc_id") % 2 == 0
    own = lambda **c: F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in c.items()])
    json_of = lambda c: F.to_json(c)
    pieces = {
        "overview": F.regexp_extract(json_of(own(q=F.col("x"))), r"(?s)^\{\"q\":(.*)\}$", 1), "announcement_count": F.when(F.col("doc_id") % 3 != 0, F.col("n_chars").cast("string")).otherwise("null"),
        "timeline": F.when(even, json_of(F.array(own(announced_at=F.col("l"), title=F.col("s"), summary=F.col("x"))))).otherwise(json_of(F.array(own(title=F.col("s"))))),
        "material_changes": F.concat(F.lit('["'), "l", F.lit('", " ", null, '), F.col("doc_id").cast("string"), F.lit("]")),
        "key_financial_figures": F.concat(F.lit("["), json_of(own(metric=F.col("l"), value=F.col("n_chars"), period=F.col("s"))), F.lit(', {"value": "v"}, {"metric": "none"}, "no object"]')),
        "corporate_actions": F.concat(F.lit("["), json_of(own(b=F.col("doc_id"), a=F.col("l"))), F.lit(', " plain "]')), "expansion_projects": json_of(own(k=F.col("l"))),
        "management_or_control_changes": F.concat(F.lit('" '), "s", F.lit(' "')), "capital_structure_events": F.lit("[]"), "listing_or_regulatory_events": F.lit("true"),
        "analytical_scenarios": F.concat(F.lit("["), json_of(own(topic=F.col("l"), classification="c", confidence="high", analysis=F.col("x"), basis=F.array(F.lit("b1"), F.lit(" b2")), caveats=F.array("s"))), F.lit(', {"analysis": "alone", "assumptions": [" "]}]')),
        "risks_or_uncertainties": F.col("doc_id").cast("string"), "items_to_monitor": F.lit('["# not a heading", "**bold** `code`"]'), "limitations": F.lit("null"),
    }
    summary = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in pieces.items()]), F.lit("}"))
    # A column of its own, the summary is parsed once and not for each of its sections.
    rows = d.select("doc_id", summary.alias("j")).select("doc_id", F.parse_json("j").alias("v")).select("doc_id", render.digest_lines(F.col("v"), list(SECTIONS)).alias("lines"))
    text = lambda c: F.md5(F.array_join(c, "\n").cast("binary"))
    return rows.select("doc_id", text(F.col("lines")).alias("markdown"), text(render.plain_lines(F.col("lines"))).alias("text"))


@query(f"""WITH {WINDOWS_SQL}, m AS (SELECT ticker, count(*) AS digests, sum(n)::BIGINT AS announcements FROM w GROUP BY 1)
SELECT f.fmt, m.ticker, m.digests, m.announcements, (SELECT count(DISTINCT ticker) FROM w) AS companies FROM m, (VALUES ('md'), ('txt')) f(fmt)""")
def share_files(t, spark, sf):
    """The standard share files of all saved windows, written all or none and read back"""
    room = f"{folder(spark)}/share-{uuid.uuid4().hex}"
    w = windows(t).select("ticker", "start_at", "end_at", F.to_json(F.struct(F.col("n").alias("announcement_count"), F.concat(F.lit("ticker "), F.col("ticker").cast("string")).alias("overview"))).alias("summary"))
    written = render.write_share(w, room, ["overview"])
    lines = files.written_lines(written, room, r"latest-all-companies\.[a-z]+").select(F.element_at(F.split("file", r"\."), -1).alias("fmt"), "value")
    heads = lines.select("fmt", F.regexp_extract("value", r"^(?:\*\*)?Companies:(?:\*\*)? (\d+)$", 1).try_cast("long").alias("companies")).where("companies is not null")
    # A digest's announcements come before its overview, which names the ticker: counted by what each line says.
    said = lines.select("fmt", F.regexp_extract("value", r"^ticker (\d+)$", 1).try_cast("long").alias("ticker"))
    per = said.where("ticker is not null").groupBy("fmt", "ticker").agg(F.count(F.lit(1)).alias("digests"))
    total = w.groupBy("ticker").agg(F.sum(F.get_json_object("summary", "$.announcement_count").cast("long")).alias("announcements"))
    return per.join(heads, "fmt").join(total, "ticker").select("fmt", "ticker", "digests", "announcements", "companies")
