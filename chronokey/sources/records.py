"""Byte formats: command streams, checksummed record files, their readers and writers."""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the file format.
MAGIC = b"DCWAL001"
MOST_ARGS, MOST_BULK, MOST_RECORD = 1 << 20, 512 << 20, 512 << 20
#: Rows, and bytes of values, that are sent to Spark at once.
SEND_ROWS, SEND_BYTES = 8192, 16 << 20


def frame(payload: bytes) -> bytes:
    return struct.pack("<II", len(payload), zlib.crc32(payload)) + payload


def records(data: bytes) -> Iterator[tuple[int, bytes | None, str]]:
    """(ordinal, payload, status) of a record file, up to its first torn or corrupt record, or
    ``end`` on a boundary."""
    if data[: len(MAGIC)] != MAGIC:
        yield 0, None, "torn" if MAGIC.startswith(data) else "corrupt"
        return
    at, i = len(MAGIC), 0
    while at < len(data):
        if len(data) - at < 8:
            yield i, None, "torn"
            return
        size, crc = struct.unpack_from("<II", data, at)
        body = data[at + 8 : at + 8 + size]
        if size > MOST_RECORD:
            yield i, None, "corrupt"
            return
        if len(body) < size or zlib.crc32(body) != crc:
            yield i, None, "torn" if len(body) < size else "corrupt"
            return
        yield i, body, "ok"
        at, i = at + 8 + size, i + 1
    yield i, None, "end"


def commands(data: bytes) -> Iterator[tuple[list[bytes] | None, str]]:
    """(arguments, status) of a command stream: arrays of bulk strings or inline lines; stops at
    an incomplete or malformed command."""
    at = 0

    def line(start: int) -> tuple[bytes, int] | None:
        end = data.find(b"\n", start)
        return None if end < 0 else (data[start:end].removesuffix(b"\r"), end + 1)

    def number(text: bytes) -> int | None:
        return int(text) if text.removeprefix(b"-").isdigit() else None

    while at < len(data):
        head = line(at)
        if head is None:
            yield None, "incomplete"
            return
        text, pos = head
        if not text.startswith(b"*"):
            yield [x for x in text.replace(b"\t", b" ").split(b" ") if x], "ok"
            at = pos
            continue
        n = number(text[1:])
        if n is None or n > MOST_ARGS:
            yield None, "error"
            return
        args: list[bytes] = []
        for _ in range(max(0, n)):
            head = line(pos)
            if head is None:
                yield None, "incomplete"
                return
            size = number(head[0][1:]) if head[0].startswith(b"$") else None
            if size is None or not 0 <= size <= MOST_BULK:
                yield None, "error"
                return
            pos = head[1]
            if len(data) < pos + size + 2:
                yield None, "incomplete"
                return
            if data[pos + size : pos + size + 2] != b"\r\n":
                yield None, "error"
                return
            args.append(data[pos : pos + size])
            pos += size + 2
        yield args, "ok"
        at = pos


_KINDS = {ord("+"): "simple", ord("-"): "error", ord(":"): "int", ord("$"): "bulk", ord("*"): "array"}
_COUNTED, _MOST = frozenset(("int", "bulk", "array")), {"bulk": MOST_BULK, "array": MOST_ARGS}
_INTEGER = re.compile(rb"[+-]?\d{1,19}").fullmatch


def replies(data: bytes) -> Iterator[tuple[int, list[int], str | None, bytes | None, str]]:
    """(ordinal, path, kind, value, status) of the replies in ``data``, nodes of arrays after the array
    itself: ``path`` is the places within the arrays around it, an array's value its length. Stops at
    an incomplete or malformed reply; nesting takes no recursion."""
    at, ordinal = 0, 0
    open_: list[list[int]] = []  # of each array around: place, length
    while at < len(data):
        path = [i for i, _ in open_]
        end = data.find(b"\r\n", at)
        if end < 0:
            yield ordinal, path, None, None, "incomplete"
            return
        kind, value = _KINDS.get(data[at]), data[at + 1 : end]
        number = int(value) if kind in _COUNTED and _INTEGER(value) else None
        most = _MOST.get(kind)
        if kind is None or (kind in _COUNTED and number is None) or (most is not None and not -1 <= number <= most):
            yield ordinal, path, None, None, "error"
            return
        at = end + 2
        if kind == "bulk" and number >= 0:
            if len(data) < at + number + 2:
                yield ordinal, path, None, None, "incomplete"
                return
            if data[at + number : at + number + 2] != b"\r\n":
                yield ordinal, path, None, None, "error"
                return
            value, at = data[at : at + number], at + number + 2
        yield ordinal, path, "null" if number == -1 and most else kind, None if number == -1 and most else value, "ok"
        if kind == "array" and number > 0:
            open_.append([0, number])
            continue
        while open_:
            open_[-1][0] += 1
            if open_[-1][0] < open_[-1][1]:
                break
            open_.pop()
        if not open_:
            ordinal += 1
    if open_:
        yield ordinal, [i for i, _ in open_], None, None, "incomplete"


def _sent(rows: Iterator[tuple], value: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``rows`` as batches of many rows, whatever the inputs they come from, closed early where the
    bytes at place ``value`` are many."""
    out, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        out.append(row)
        size += len(row[value] or b"")
        if len(out) >= SEND_ROWS or size >= SEND_BYTES:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def _pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(name, content) of batches of two columns; a null content is empty."""
    for p in parts:
        for name, data in zip(p.column(0).to_pylist(), p.column(1), strict=True):
            yield name, data.as_py() or b""


def scan_records(files: DataFrame) -> DataFrame:
    """(segment, ordinal, payload, status) of record files (segment, content); a null content is an
    empty file. One file is one task's work, as only its start tells where records lie."""

    schema = pa.schema([("segment", pa.string()), ("ordinal", pa.int64()), ("payload", pa.binary()), ("status", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sent(((name, *r) for name, data in _pairs(parts) for r in records(data)), 2, schema)

    return files.select("segment", "content").mapInArrow(run, "segment string, ordinal long, payload binary, status string")


def read_records(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """``scan_records`` of the files in a folder: bare ones, or, ``packed``, what ``write_records`` wrote."""
    files = spark.read.parquet(path) if packed else spark.read.format("binaryFile").load(path).withColumnRenamed("path", "segment")
    return scan_records(files)


def pack_records(df: DataFrame, order: str, most: int = 16 << 20) -> DataFrame:
    """(segment, content): the payloads of ``df`` (binary) as record files, in order within each
    partition; a file is closed once it has ``most`` bytes. Null payloads are no records; a partition
    without any gives no file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, i = TaskContext.get().partitionId(), 0
        body: list[bytes] = []
        size = 0

        def closed() -> pd.DataFrame:
            return pd.DataFrame({"segment": [f"wal-{part:06d}-{i:010d}.log"], "content": [MAGIC + b"".join(body)]})

        for p in parts:
            for x in p["payload"]:
                body.append(frame(bytes(x)))
                size += len(body[-1])
                if size >= most:
                    yield closed()
                    body, size, i = [], 0, i + 1
        if body:
            yield closed()

    return df.where("payload IS NOT NULL").sortWithinPartitions(order).select("payload").mapInPandas(run, "segment string, content binary")


def write_records(df: DataFrame, path: str, order: str, most: int = 16 << 20) -> None:
    """Write ``pack_records`` of ``df`` as a Parquet table of files, which ``read_records`` reads as ``packed``."""
    pack_records(df, order, most).write.mode("errorifexists").parquet(path)


def parse_replies(df: DataFrame, column: str = "data") -> DataFrame:
    """(row, ordinal, path, kind, value, status) of each stream of replies; a null stream has none."""

    schema = pa.schema([("row", pa.int64()), ("ordinal", pa.int64()), ("path", pa.list_(pa.int32())), ("kind", pa.string()), ("value", pa.binary()), ("status", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sent(((row, *r) for row, data in _pairs(parts) for r in replies(data)), 4, schema)

    return df.select("row", column).mapInArrow(run, "row long, ordinal long, path array<int>, kind string, value binary, status string")


def parse_commands(df: DataFrame, column: str = "data") -> DataFrame:
    """(row, ordinal, args, status) of each command stream."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(row, i, args, status) for row, data in zip(p["row"], p[column], strict=True) for i, (args, status) in enumerate(commands(bytes(data or b"")))]
            yield pd.DataFrame(rows, columns=["row", "ordinal", "args", "status"])

    return df.select("row", column).mapInPandas(run, "row long, ordinal int, args array<binary>, status string")


def read_load_tests(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of load tests with the file's number."""
    raw = spark.read.json(path).withColumn("file", F.input_file_name())
    names = raw.select("file").distinct()
    from pyspark.sql import Window

    return raw.join(F.broadcast(names.withColumn("file_index", F.dense_rank().over(Window.orderBy("file")) - 1)), "file")
