"""What workers hold: tables are mapped and not copied, and an operator's things go when another one comes."""

from __future__ import annotations

import mmap

import numpy as np

from pyspark.sql import functions as F


def test_op8_tables_are_mapped_and_found(spark):
    from tidemark.llm.lookup import write_lookup

    rows = spark.range(5000).select((F.col("id") * 7919 - 9_000_000).alias("key"), (F.col("id") / 4).cast("float").alias("llr"), (F.col("id") % 3 == 0).alias("strong"))
    table = write_lookup(rows, "test-lookup")
    assert sum(n for _, n, _ in table.parts) == 5000
    for part in table.columns():
        for column in part:
            base = column
            while isinstance(base, np.ndarray):
                base = base.base
            assert isinstance(base, mmap.mmap)  # the machine's pages, not the worker's
    asked = np.array([7919 * 12 - 9_000_000, -1, -9_000_000, 7919 * 4999 - 9_000_000, 2**62], dtype=np.int64)
    hit, (llr, strong) = table.find(asked)
    assert hit.tolist() == [True, False, True, True, False]
    assert llr.tolist() == [3.0, 0.0, 0.0, 4999 / 4, 0.0] and strong.tolist() == [True, False, True, False, False]
    none = write_lookup(rows.where("false"), "test-lookup")
    assert not none.find(asked)[0].any()


def test_pipeline_worker_drops_what_another_operator_kept():
    from tidemark.llm import textcore

    first = textcore.keep_only("one", lambda: [1])
    assert textcore.keep_only("one", lambda: [2]) is first
    textcore.keep_only("two", lambda: [2])
    assert list(textcore._kept) == ["two"]
    textcore.keep_nothing()
    assert not textcore._kept
