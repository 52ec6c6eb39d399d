"""Sorted tables that all workers of a machine share.

A table of keys and numbers is written once, dealt by ranges of its key and sorted, each column of a part as a flat file in
the shared folder. Where that folder is a path of the machine a worker maps the files, so their pages are the machine's,
held once and given up when room is short; elsewhere it reads them whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import fresh_path

KINDS = {"bigint": "<i8", "double": "<f8", "float": "<f4", "boolean": "?"}


def _read(uri: str, kind: str, rows: int) -> np.ndarray:
    system, path = fs.FileSystem.from_uri(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r", shape=(rows,)).view(np.ndarray)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype=kind, count=rows)


@dataclass(frozen=True)
class Lookup:
    folder: str
    names: tuple[str, ...]  # of the columns, the key's first
    kinds: tuple[str, ...]
    parts: tuple[tuple[str, int, int], ...]  # name, rows and first key of each, in order

    def columns(self) -> list[list[np.ndarray]]:
        return [[_read(f"{self.folder}/{part}.{c}", k, rows) for c, k in zip(self.names, self.kinds, strict=True)] for part, rows, _ in self.parts]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which of ``keys`` are there, and their values (zero for others)."""
        hit, values = np.zeros(len(keys), bool), [np.zeros(len(keys), k) for k in self.kinds[1:]]
        order = slice(None) if (keys[1:] >= keys[:-1]).all() else np.argsort(keys)
        asked = keys[order]
        edges = np.append(np.searchsorted(asked, np.array([first for _, _, first in self.parts], dtype=np.int64)), len(keys))
        for (known, *columns), lo, hi in zip(opened(self), edges[:-1], edges[1:], strict=True):
            if lo < hi:
                at = np.minimum(np.searchsorted(known, asked[lo:hi]), len(known) - 1)
                found = known[at] == asked[lo:hi]
                place = slice(lo, hi) if isinstance(order, slice) else order[lo:hi]
                hit[place] = found
                for value, column in zip(values, columns, strict=True):
                    value[place] = np.where(found, column[at], value.dtype.type(0))
        return hit, values

    def drop(self, spark: SparkSession) -> None:
        drop_folder(spark, self.folder)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete what nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: What this worker has open, by folder: at most ``MOST_OPEN`` tables, the last ones asked.
_opened: dict[str, list[list[np.ndarray]]] = {}
MOST_OPEN = 3


def close_mapped() -> None:
    """At a task's end: a mapped file is opened again at no cost, and one that is deleted takes room while it is mapped."""
    for folder in [f for f in _opened if isinstance(fs.FileSystem.from_uri(f)[0], fs.LocalFileSystem)]:
        del _opened[folder]


def opened(table: Lookup) -> list[list[np.ndarray]]:
    found = _opened.pop(table.folder, None)
    while found is None and len(_opened) >= MOST_OPEN:
        _opened.pop(next(iter(_opened)))
    _opened[table.folder] = table.columns() if found is None else found
    return _opened[table.folder]


def write_lookup(table: DataFrame, tag: str) -> Lookup:
    """``table`` (its first column a long, no value twice; the others numbers) as a ``Lookup``. The driver gets one row a part."""
    names, kinds = table.columns, [KINDS[kind] for _, kind in table.dtypes]
    folder, key = fresh_path(table.sparkSession, tag), table.columns[0]

    def save(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A name of its own: what a failed or second attempt wrote is not told, so nobody reads it.
        part, rows, first, files = uuid.uuid4().hex, 0, 0, []
        for batch in batches:
            if not len(batch):
                continue
            if not files:
                system, path = fs.FileSystem.from_uri(folder)
                system.create_dir(path)
                files = [system.open_output_stream(f"{path}/{part}.{c}", buffer_size=1 << 20) for c in names]
                first = batch.column(0)[0].as_py()
            for file, column, kind in zip(files, batch.columns, kinds, strict=True):
                file.write(column.to_numpy(zero_copy_only=False).astype(kind).tobytes())
            rows += len(batch)
        for file in files:
            file.close()
        if rows:
            yield pa.record_batch([pa.array([part]), pa.array([rows], pa.int64()), pa.array([first], pa.int64())], names=["part", "rows", "first"])

    told = table.where(F.col(key).isNotNull()).repartitionByRange(key).sortWithinPartitions(key).mapInArrow(save, "part string, rows long, first long").collect()
    return Lookup(folder, tuple(names), tuple(kinds), tuple(sorted(((r["part"], r["rows"], r["first"]) for r in told), key=lambda p: p[2])))
