"""A paged range source: one input partition per page, and the report that proves a read complete.

A page provider is any object with ``page(offset, size, **query) -> (rows, reported_total)``; rows are dicts. Transport
(HTTP, sessions, pacing) is the provider's business.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.operators.store import latest_per_key


class PageProvider(Protocol):
    def page(self, offset: int, size: int) -> tuple[list[dict], int]: ...


@dataclass
class Page(InputPartition):
    number: int
    offset: int
    size: int


class PagedReader(DataSourceReader):
    def __init__(self, provider: PageProvider, size: int) -> None:
        self.provider, self.size = provider, size

    def partitions(self) -> list[InputPartition]:
        _, total = self.provider.page(0, 1)
        return [Page(k, at, self.size) for k, at in enumerate(range(0, max(total, 1), self.size))]

    def read(self, partition: Page) -> Iterator[tuple]:
        rows, total = self.provider.page(partition.offset, partition.size)
        yield from ((r.get("id2"), r.get("payload"), partition.number, k, total) for k, r in enumerate(rows))


def paged_source(provider: PageProvider, size: int, name: str = "paged") -> type[DataSource]:
    """A data source class over a provider, to be registered under ``name``."""

    class PagedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "id2 string, payload string, page int, place int, reported long"

        def reader(self, schema) -> DataSourceReader:
            return PagedReader(provider, size)

    return PagedSource


def scan(spark: SparkSession, provider: PageProvider, size: int, name: str = "paged") -> DataFrame:
    spark.dataSource.register(paged_source(provider, size, name))
    return spark.read.format(name).load()


def first_wins(raw: DataFrame) -> DataFrame:
    """Records without an id go; of several with one id the first by page and place stays."""
    return latest_per_key(raw.where("id2 is not null and id2 <> ''"), ["id2"], ["page", "place"])


def completeness(raw: DataFrame, size: int) -> DataFrame:
    """One row: what was reported, collected and distinct, pages seen, and whether that proves a complete read."""
    facts = raw.agg(
        F.max("reported").alias("reported"), F.count(F.lit(1)).alias("collected"), F.count_distinct(F.when(F.col("id2") != "", F.col("id2"))).alias("distinct_ids"), F.count_distinct("page").alias("pages")
    )
    return facts.withColumn("complete", (F.coalesce("reported", F.lit(0)) == 0) | (F.col("collected") >= F.col("reported")))


def wide_page(reported: int, base: int, most: int, normal: int) -> int | None:
    """The size of one page that would hold everything, or None where a wide probe is pointless."""
    return None if reported > most or most <= normal else min(most, max(base, reported))


def ladder(attempts: list[tuple[str, DataFrame, int]]) -> tuple[str, DataFrame]:
    """The first attempt (label, raw rows, page size) whose report is complete; else all of them, first wins, as partial."""
    for label, raw, size in attempts:
        if completeness(raw, size).first()["complete"]:
            return label, first_wins(raw)
    union = attempts[0][1].withColumn("page", F.col("page"))
    for k, (_, raw, _) in enumerate(attempts[1:], 1):
        union = union.unionByName(raw.withColumn("page", F.col("page") + k * 1_000_000))
    return f"{attempts[-1][0]}-partial", first_wins(union)


def day_shards(start, end) -> "F.Column":
    """The days of a range, for one read each."""
    return F.sequence(start.cast("date"), end.cast("date"))
