"""Attachments of one announcement out of two sources, as one list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.lineage import cut


def _blank(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def merge_candidates(first: DataFrame, second: DataFrame, columns: list[str], order: list[str], group: str = "group_id") -> DataFrame:
    """Attachments of both sources as one list for each ``group``: the order is that of ``first``, then ``second``, each by
    ``order``, which must tell a group's rows apart. A row with the url of a listed one joins it; else a row with its name
    (without case) does; else it is listed itself. The listed row's blank ``columns`` are filled by those that join it, in
    order, whether of its own source or the other.

    Which rows are listed is settled in rounds for all groups at once: a row that no open row of its url or name precedes is
    listed if no listed one has them, and joins otherwise. Grouped minima settle a round, so no group is gathered; the number
    of rounds is that of the longest chain of alternating urls and names. Rows, urls and names are numbers in the rounds, and a
    round meets only rows still open and those that the last one listed. ``url`` and ``filename`` are columns of both; null
    is blank, and blank matches nothing.
    """
    wanted = list(dict.fromkeys([*columns, "url", "filename"]))
    both = first.select(group, *order, *wanted, F.lit(0).alias("_source")).unionByName(second.select(group, *order, *wanted, F.lit(1).alias("_source")))
    # Numbers in the order of groups and places: ranges are dealt in order, and so are the rows of each.
    place = [group, "_source", *order]
    numbered = both.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("_i", F.monotonically_increasing_id())
    rows = cut(numbered.select("_i", F.col(group).alias("_group"), *wanted), "attachments").select(
        "_i", F.struct(F.coalesce(F.col("_group").cast("string"), F.lit("")).alias("g"), F.col("_group").isNull().alias("n")).alias("_g"), "_group",
        F.trim("url").alias("_url"), F.translate(F.replace(F.lower(F.trim("filename")), F.lit("ß"), F.lit("ss")), "ς", "σ").alias("_name"), *[F.col(c).alias(f"_c_{c}") for c in columns],
    )
    open_rows = rows.select("_g", "_url", "_name", "_i")
    for k, c in (("_u", "_url"), ("_f", "_name")):
        first = open_rows.where(~_blank(F.col(c))).groupBy("_g", c).agg(F.min("_i").alias(k))  # the first row that has it names a url or name
        # A blank has a number of its own, which no other row has.
        open_rows = open_rows.join(first, ["_g", c], "left").withColumn(k, F.coalesce(k, -1 - F.col("_i")))
    # The first round needs no more than these numbers: who names both its url and its name is preceded by nobody.
    own = lambda k: (F.col(k) == F.col("_i")) | (F.col(k) < 0)
    told = cut(open_rows.select("_i", "_u", "_f", F.lit(None).cast("long").alias("_at"), F.when(own("_u") & own("_f"), F.col("_i")).alias("_into")), "attachments")
    done = []
    while True:
        settled = told.where("_into is not null")
        done.append(settled.select("_i", "_into"))
        fresh, open_rows = settled.where("_i = _into"), told.where("_into is null").drop("_into")
        if open_rows.isEmpty():
            break
        ahead = open_rows
        for k in ("_u", "_f"):
            met = open_rows.select(k, F.col("_i").alias("_o"), F.lit(None).cast("long").alias("_l")).unionByName(fresh.select(k, F.lit(None).cast("long").alias("_o"), F.col("_i").alias("_l")))
            ahead = ahead.join(met.groupBy(k).agg(F.min("_o").alias(f"_open{k}"), F.max("_l").alias(f"_listed{k}")), k)
        free = lambda k: F.col(f"_open{k}") == F.col("_i")
        # A listed row of its name is remembered while an open row of its url precedes.
        named = F.coalesce("_at", "_listed_f")
        into = F.when(F.col("_listed_u").isNotNull(), F.col("_listed_u")).when(free("_u"), F.when(named.isNotNull(), named).when(free("_f"), F.col("_i")))
        told = cut(ahead.select("_i", "_u", "_f", named.alias("_at"), into.alias("_into")), "attachments")
    joined = rows.select("_i", "_group", *[f"_c_{c}" for c in columns]).join(reduce(DataFrame.unionByName, done), "_i")
    filled = [F.min_by(f"_c_{c}", F.when(~_blank(F.col(f"_c_{c}")), F.col("_i"))).alias(f"_v_{c}") for c in columns]
    own = [F.max(F.when(F.col("_i") == F.col("_into"), F.col(f"_c_{c}"))).alias(f"_o_{c}") for c in columns]
    merged = joined.groupBy("_into").agg(F.first("_group").alias(group), *filled, *own)
    return merged.select(group, *[F.coalesce(f"_v_{c}", f"_o_{c}").alias(c) for c in columns])
