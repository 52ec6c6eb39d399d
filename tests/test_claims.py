"""Claims of every shape, sources of every kind, and the table function for maps."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import claims, extension, provenance


def test_claims_of_every_shape(spark):
    values = [" a\n", {"analysis": " why "}, {"metric": "m", "value": 0, "period": "p"}, {"value": 3}, {"b": {"z": 1, "a": "é"}, "a": [1, "x"]}, 7, None, True, "", {"analysis": "", "metric": ""}, 1.5]
    summary = json.dumps({"material_changes": values, "corporate_actions": "no list", "other": ["x"], "items_to_monitor": [], "risks_or_uncertainties": {"k": "v"}})
    df = spark.createDataFrame([(1, summary), (2, "{broken"), (3, "[1]"), (4, None), (5, "{}")], "c int, s string")
    got = sorted((r.place, r.claim) for r in claims.claim_rows(df, "c", "s").collect())
    want = ["a", "why", "m — p", "3", '{"a": [1, "x"], "b": {"a": "é", "z": 1}}', "7", "None", "True", None, '{"analysis": "", "metric": ""}', "1.5"]
    assert got == [(k, w) for k, w in enumerate(want) if w is not None]


def test_sources_named_single_and_inferred(spark):
    summary = json.dumps({"material_changes": ["alpha beta gamma", "nothing alike", "told twice"], "claim_sources": [
        {"claim": "told twice", "announcement_ids": ["9"]}, {"claim": "told twice", "announcement_ids": ["2", "9", "1"], "classification": "estimate"}, {"announcement_ids": ["1"]}, 3]})
    df = spark.createDataFrame([(1, summary), (2, json.dumps({"items_to_monitor": ["x"]})), (3, json.dumps({"items_to_monitor": ["y"]}))], "c int, s string")
    said = spark.createDataFrame([(1, 1, "alpha beta"), (1, 2, "gamma alpha beta"), (2, 5, None)], "company int, id2 int, text string")
    got = {r.claim: (r.attribution, r.source_ids, r.match_score, r.classification) for r in claims.trace_claims(df, said, "c", "s").collect()}
    assert got == {
        "alpha beta gamma": ("inferred_from_saved_summaries", ["2"], 1.0, "explicit_fact"), "nothing alike": ("unresolved", [], None, "explicit_fact"),
        "told twice": ("exact_model_reference", ["2", "1"], None, "estimate"), "x": ("deterministic_single_announcement", ["5"], 1.0, "explicit_fact"), "y": ("unresolved", [], None, "explicit_fact"),
    }


def test_matching_by_rare_tokens_loses_nothing(spark):
    import random

    rng = random.Random(6)
    words = [f"w{k:02d}" for k in range(30)]
    text = lambda n: " ".join(rng.choice(words[: rng.choice((6, 30))]) for _ in range(n))
    a, b = [(k, text(rng.randint(1, 16))) for k in range(60)], [(k, text(rng.randint(0, 9))) for k in range(40)]
    want = []
    for k, x in a:
        t = set(x.split())
        scored = sorted(((len(t & set(y.split())) / len(t), j) for j, y in b), reverse=True)
        if scored[0][0] >= 0.2:
            want.append((k, scored[0][1], 1))
            if scored[1][0] >= max(0.2, scored[0][0] - 0.08):
                want.append((k, scored[1][1], 2))
    got = provenance.match_sources(spark.createDataFrame(a, "c int, text string"), spark.createDataFrame(b, "s int, text string"), "c", "s")
    assert sorted((r.c, r.s, r["rank"]) for r in got.collect()) == sorted(want)


def test_map_function_by_name(spark):
    extension.register_maps(spark, {"words": (lambda t: ((w, len(w)) for w in t.split()), "w string, n int"), "size": (lambda t: [(len(t),)], "n int")}, "maps_of_test")
    df = spark.createDataFrame([(1, "a bb"), (2, None), (3, "")], "id int, text string")
    assert sorted(tuple(r) for r in spark.sql("SELECT d.id, m.* FROM {d} d, LATERAL maps_of_test(d.text, 'words') m", d=df).collect()) == [(1, "a", 1), (1, "bb", 2)]
    assert spark.sql("SELECT d.id, m.n FROM {d} d, LATERAL maps_of_test(d.text, 'size') m", d=df).where(F.col("n") >= 0).count() == 2
    with pytest.raises(Exception):
        spark.sql("SELECT * FROM {d} d, LATERAL maps_of_test(d.text, 'other') m", d=df)
