"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some whole WARC records, then one skippable frame
with the seek table (compressed and decompressed size of every frame) and a footer that readers find at the end of
the file. The index maps a record's identifier to (bundle, frame, offset in the frame's decompressed bytes, length),
so one record costs one range read and one frame.

Tasks write bundles straight to the shared folder through a file-system URI. A task attempt names its files freshly
and only the index rows of the attempt that Spark commits survive, so a lost executor leaves at most unread files.

Defined cases: a null payload is empty; rows that share the smallest identifier of a payload are all responses; a
payload known only under null identifiers is a response each time; an empty table makes an empty index. Payloads go
through one task a row at a time, so a very long one costs its own size only. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import fresh_path, materialize

SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id long, bundle string, frame int, frame_at long, frame_bytes long, offset long, length long"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle: (compressed, decompressed) size of each frame."""
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, FOOTER)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int, int]]:
    """(file offset, compressed size, decompressed offset, decompressed size) of each frame of an open bundle."""
    size = file.size()
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != FOOTER or flags & 0x7C:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - count * width)
    table, at, plain = [], 0, 0
    raw = file.read(count * width)
    for k in range(count):
        c, d = struct.unpack_from("<II", raw, k * width)
        table.append((at, c, plain, d))
        at, plain = at + c, plain + d
    return table


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but names the response and keeps its digest and length."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {''.join((url or '').split())}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The header fields of a record, with ``payload`` (bytes; of a revisit, none)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    fields["payload"] = block.partition(b"\r\n\r\n")[2]
    return fields


def _base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class _Bundle:
    """Writes records into frames of about ``frame_bytes`` and keeps where each stands."""

    def __init__(self, folder: str, frame_bytes: int, level: int) -> None:
        self.system, path = fs.FileSystem.from_uri(folder)
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self.file = self.system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.most, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.filled = self.written = 0
        self.rows: list[tuple] = []
        self.pending: list[tuple] = []

    def add(self, key: int | None, raw: bytes) -> None:
        self.pending.append((key, self.filled, len(raw)))
        self.open.append(raw)
        self.filled += len(raw)
        if self.filled >= self.most:
            self.cut()

    def cut(self) -> None:
        if not self.open:
            return
        packed = self.packer.compress(b"".join(self.open))
        self.file.write(packed)
        self.rows += [(key, self.name, len(self.frames), self.written, len(packed), at, n) for key, at, n in self.pending]
        self.frames.append((len(packed), self.filled))
        self.written += len(packed)
        self.open, self.pending, self.filled = [], [], 0

    def close(self) -> list[tuple]:
        self.cut()
        self.file.write(seek_table(self.frames))
        self.file.close()
        return self.rows


def with_revisits(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with the payload's digest in hex and ``refers_to``."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "_sha", F.sha1(F.col("html").cast("binary"))
    )
    # A row a payload that has copies: the copies themselves are pre-aggregated in each task before the shuffle.
    first = (
        rows.where(F.octet_length("html") >= min_payload)
        .groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1").drop("_n")
    )
    return rows.join(first, "_sha", "left").withColumn(
        "refers_to", F.when(F.col("_first") < F.coalesce("page_id", F.lit(2**63 - 1)), F.col("_first"))
    ).drop("_first")


def write_bundles(
    pages: DataFrame, folder: str | None = None, min_payload: int = 0, frame_bytes: int = 256 << 10,
    bundle_bytes: int = 1 << 30, level: int = 3,
) -> tuple[str, DataFrame]:
    """Write a record for each row of ``pages``; returns (folder, index)."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "bundle", "frame", "frame_at", "frame_bytes", "offset", "length"]
        types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        bundle = None
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                page_id, url, html, refers = (v.as_py() for v in row)
                payload = html.encode("utf-8", "surrogatepass")
                bundle = bundle or _Bundle(folder, frame_bytes, level)
                bundle.add(page_id, record(page_id, url, payload, _base32_sha1(payload), refers))
                if bundle.written >= bundle_bytes:
                    yield out(bundle.close())
                    bundle = None
        if bundle:
            yield out(bundle.close())

    index = with_revisits(pages, min_payload).select("page_id", "url", "html", "refers_to").mapInArrow(write, INDEX)
    return folder, materialize(index, "warc-index")


RECORD = "record_id long, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read_records(folder: str, index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that ``index`` lists (all, or the rows a caller has picked), each read from its own frame.

    Frames are read once for all their listed records; the digest of a response is computed anew from what was read
    and must equal the one in its header.
    """
    frames = index.groupBy("bundle", "frame", "frame_at", "frame_bytes").agg(
        F.sort_array(F.collect_list(F.struct("offset", "length", "record_id"))).alias("records")
    )

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor()
        name, file, table = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != name:
                    if file:
                        file.close()
                    name = row["bundle"]
                    file = system.open_input_file(f"{path}/{name}")
                    table = read_seek_table(file)
                at, size, _, plain = table[row["frame"]]
                if (at, size) != (row["frame_at"], row["frame_bytes"]):
                    raise ValueError(f"{name}: the index and the seek table differ at frame {row['frame']}")
                file.seek(at)
                data = unpack.decompress(file.read(size), max_output_size=plain)
                out = []
                for entry in row["records"]:
                    got = parse(data[entry["offset"] : entry["offset"] + entry["length"]])
                    kind, digest = got["WARC-Type"], got["WARC-Payload-Digest"].removeprefix("sha1:")
                    count = int(got["X-Payload-Length"])
                    if kind == "response" and (count, digest) != (len(got["payload"]), _base32_sha1(got["payload"])):
                        raise ValueError(f"{name}: record {got['WARC-Record-ID']} is damaged")
                    refers = got.get("WARC-Refers-To")
                    out.append((
                        _page(got["WARC-Record-ID"]), kind, got["WARC-Target-URI"],
                        got["payload"] if payloads and kind == "response" else None, count, digest, refers and _page(refers),
                    ))
                columns = zip(*out, strict=True)
                types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    names=["record_id", "record_type", "url", "payload", "payload_bytes", "payload_digest", "refers_to"],
                )
        if file:
            file.close()

    # A bundle's frames in file order in one task: one open file at a time.
    return frames.repartition("bundle").sortWithinPartitions("bundle", "frame").mapInArrow(read, RECORD)


def _page(urn: str) -> int | None:
    tail = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if tail == "null" else int(tail)
