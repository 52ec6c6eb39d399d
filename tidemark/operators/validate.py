"""Strict validation of JSON documents: what ``from_json`` would coerce or drop is an error here."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None),
}


def _is(value: object, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, KINDS[kind]) if kind in KINDS else True


def first_error(value: object, schema: dict, path: str = "$") -> str | None:
    """Where and why a value breaks a schema, or None."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_is(value, k) for k in kinds):
            return f"{path}: type"
        if value is None and len(kinds) > 1:
            return None
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: enum"
    if isinstance(value, str) and len(value.strip()) < schema.get("minLength", 0):
        return f"{path}: blank"
    if isinstance(value, int) and "minimum" in schema and value < schema["minimum"]:
        return f"{path}: minimum"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if lost := [k for k in schema.get("required", ()) if k not in value]:
            return f"{path}: missing {lost[0]}"
        if schema.get("additionalProperties") is False and (extra := [k for k in value if k not in known]):
            return f"{path}: unexpected {extra[0]}"
        children = [(value[k], s, f"{path}.{k}") for k, s in known.items() if k in value]
    elif isinstance(value, list) and "items" in schema:
        children = [(x, schema["items"], f"{path}[{k}]") for k, x in enumerate(value)]
    else:
        children = []
    return next((e for e in (first_error(*c) for c in children) if e), None)


def validated(rows: DataFrame, column: str, schema: dict) -> DataFrame:
    """``rows`` with ``error``: null where the JSON text of ``column`` follows ``schema``. Arrow batches."""

    @F.pandas_udf("string")
    def check(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return first_error(json.loads(text), schema)
            except (TypeError, ValueError):
                return "$: not JSON"

        return texts.map(one)

    return rows.withColumn("error", check(F.col(column)))


def flat_object_ok(text: Column, integers: list[str]) -> Column:
    """JVM-side strict test of a flat object whose keys are exactly ``integers`` and whose values are integers."""
    keys = F.json_object_keys(text)
    same = (F.size(keys) == len(integers)) & (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in integers]))) == 0)
    typed = F.lit(True)
    for k in integers:
        typed &= F.get_json_object(text, f"$.{k}").rlike(r"^-?[0-9]+$")
    return F.coalesce(same & typed, F.lit(False))


def usable_legacy(strings: list[Column], arrays: list[Column]) -> Column:
    """The lenient rule for old summaries: any text that isn't blank, or any list that isn't empty."""
    out = F.lit(False)
    for s in strings:
        out |= F.coalesce(F.trim(s) != "", F.lit(False))
    for a in arrays:
        out |= F.coalesce(F.size(a) > 0, F.lit(False))
    return out


def isolated(rows: DataFrame, ticker: str) -> Column:
    """Whether every non-blank ticker of ``rows`` is the wanted one (an aggregate)."""
    return F.bool_and(F.coalesce(F.trim(F.col("ticker")) == "", F.lit(True)) | (F.upper(F.trim(F.col("ticker"))) == ticker.strip().upper()))
