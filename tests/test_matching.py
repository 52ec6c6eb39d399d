"""Claims and sources of many small groups and of a large one."""

from __future__ import annotations

import random

from tidemark.operators import claims, provenance


def test_small_groups_meet_outright_and_large_ones_by_index(spark, monkeypatch):
    written = []
    monkeypatch.setattr(provenance, "cut", lambda df, tag, real=provenance.cut: written.append((tag, df.columns, real(df, tag))) or written[-1][2])
    rng = random.Random(3)
    words = [f"w{k:02d}" for k in range(25)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    size = lambda g: 30 if g == 7 else 3
    a = [(g, k, text(rng.randint(0, 9))) for g in range(20) for k in range(size(g))] + [(99, 0, "w01"), (None, 1, "w01")]
    b = [(g, k, text(rng.randint(0, 9))) for g in range(20) for k in range(size(g))] + [(None, 1, "w01"), (3, 8, None)]
    want = []
    for g, k, x in a:
        t = set(x.split())
        scored = sorted(((len(t & set((y or "").split())) / len(t), j) for h, j, y in b if h == g and g is not None), reverse=True) if t else []
        if scored and scored[0][0] >= 0.2:
            want.append((g, k, scored[0][1], 1))
            if len(scored) > 1 and scored[1][0] >= max(0.2, scored[0][0] - 0.08):
                want.append((g, k, scored[1][1], 2))
    frames = spark.createDataFrame(a, "g int, c int, text string"), spark.createDataFrame(b, "g int, s int, text string")
    got = provenance.match_sources(*frames, "c", "s", group=["g"])
    assert sorted((r.g, r.c, r.s, r["rank"]) for r in got.collect()) == sorted(want)
    # Tokens are written for the one large group only.
    tokens = [df for tag, columns, df in written if "tok" in columns]
    assert tokens and all({r.g for r in df.select("g").distinct().collect()} == {7} for df in tokens)


def test_a_claim_is_made_once(spark, monkeypatch):
    df = spark.createDataFrame([(1, '{"material_changes": ["a", "", {"z": 1, "b": 2}]}')], "company int, s string")
    told = []
    monkeypatch.setattr(claims, "cut", lambda d, tag, real=claims.cut: told.append(d) or real(d, tag))
    got = claims.trace_claims(df, spark.createDataFrame([(1, 5, "x")], "company int, id2 int, text string"), "company", "s")
    assert sorted(r.claim for r in got.select("claim").collect()) == ["a", '{"b": 2, "z": 1}']
    assert told[0]._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_attachments_are_ordered_by_no_window(spark):
    from tidemark.operators import selection

    t = "Financial Statement"
    rows = [("a", t, "financial statement b.pdf", True, 2), ("a", t, "financial statement a.pdf", False, 1), ("a", t, "x.xlsx", True, 3),
            ("b", t, "financial statement.pdf", True, 1), ("b", t, "financial statement.pdf", True, 1), ("b", t, "financial statement.pdf", True, None),
            ("c", t, "laporan keuangan.pdf", False, 1), ("c", t, "financial statement.pdf", False, 0), ("d", t, "other.pdf", False, 1)]
    df = spark.createDataFrame(rows, "g string, title string, filename string, is_attachment boolean, position int")
    out = selection.classify(df, ["g"])
    got = sorted((r.g, r.filename, r.position if r.position is not None else -1, r.category.removeprefix("financial_statement")) for r in out.collect())
    assert got == [
        ("a", "financial statement a.pdf", 1, ""), ("a", "financial statement b.pdf", 2, "_duplicate"), ("a", "x.xlsx", 3, ""),
        ("b", "financial statement.pdf", -1, ""), ("b", "financial statement.pdf", 1, "_duplicate"), ("b", "financial statement.pdf", 1, "_duplicate"),
        ("c", "financial statement.pdf", 0, "_duplicate"), ("c", "laporan keuangan.pdf", 1, ""), ("d", "other.pdf", 1, ""),
    ]
    twice = selection.classify(df.where("g = 'b' and position = 1"), ["g"])
    assert sorted(r.category for r in twice.collect()) == ["financial_statement", "financial_statement_duplicate"]
    plan = selection.classify(df, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Window [") == 1


def test_few_claims_go_to_the_sources_and_no_tokens_are_written(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{k:02d}" for k in range(40)]
    text = lambda n: " ".join(rng.choice(words[: rng.choice((8, 40))]) for _ in range(n))
    a = spark.createDataFrame([(f"c{k}", text(rng.randint(0, 12))) for k in range(50)] + [("n", None)], "c string, text string")
    b = spark.createDataFrame([(k, text(rng.randint(0, 20))) for k in range(300)] + [(900, None)], "s long, text string").repartition(5)
    written = []
    monkeypatch.setattr(provenance, "cut", lambda df, tag, real=provenance.cut: written.append(tag) or real(df, tag))
    told = lambda: sorted((r.c, r.s, r.score, r["rank"]) for r in provenance.match_sources(a, b, "c", "s").collect())
    few = told()
    assert len(few) > 50 and not {"source-tokens", "claim-pairs"} & set(written)
    monkeypatch.setattr(provenance, "FEW_TOKENS", 0)
    assert told() == few and "source-tokens" in written
    assert provenance.match_sources(a.where("c = 'n'"), b, "c", "s").count() == 0
