"""Extension point: map functions that make several rows of a chunk, called in SQL beside any table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def register_maps(spark: SparkSession, maps: dict[str, tuple[Callable[[str], Iterable[tuple]], str]], name: str = "map_chunk") -> None:
    """``name(text, 'map')`` as a table function whose columns are those of the map named: ``maps`` gives each one's function (of a text,
    to rows) and columns (DDL). It is called ``FROM chunks c, LATERAL map_chunk(c.text, 'map') m``; a null text makes no row, rows
    travel as Arrow batches, and an unknown map fails when the query is analysed, not in a task."""
    schemas = {k: StructType.fromDDL(ddl).json() for k, (_, ddl) in maps.items()}
    functions = {k: f for k, (f, _) in maps.items()}

    class MapChunk:
        @staticmethod
        def analyze(text: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
            import json

            if not kind.isConstantExpression or kind.value not in schemas:
                raise ValueError(f"the second argument must be one of {sorted(schemas)}")
            return AnalyzeResult(StructType.fromJson(json.loads(schemas[kind.value])))

        def eval(self, text: str, kind: str) -> Iterator[tuple]:
            if text is not None:
                yield from functions[kind](text)

    spark.udtf.register(name, F.udtf(MapChunk, useArrow=True))
