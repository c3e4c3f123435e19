"""The data source "vector-records": binary files of records.

Values of the format: a magic (VEC1, or what the option magic says), version 1 as four bytes and the number of records as
eight; for each record the length of its id and the id, the number of components and these as
four-byte floats, the length of its metadata and that as JSON (length 0: none). All numbers are little-endian.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MAGIC = b"VEC1"
VERSION = 1
#: Bytes of a file at most, so that a task can hold one.
FILE_BYTES = 32 << 20
SCHEMA = "id string, vector array<float>, metadata string"


def packed(id_: str, vector: list[float], metadata: str | None) -> bytes:
    raw, meta = id_.encode(), (metadata or "").encode()
    return struct.pack("<I", len(raw)) + raw + struct.pack(f"<I{len(vector)}f", len(vector), *vector) + struct.pack("<I", len(meta)) + meta


def unpacked(data: bytes, magic: bytes = MAGIC) -> Iterator[tuple[str, list[float], str | None]]:
    """The records of a file; ValueError if it is cut short or something else."""
    if data[: len(magic)] != magic:
        raise ValueError("not a file of vector records")
    try:
        version, count = struct.unpack_from("<IQ", data, len(magic))
        if version != VERSION:
            raise ValueError(f"unknown version {version}")
        at = len(magic) + 12
        for _ in range(count):
            (n,) = struct.unpack_from("<I", data, at)
            id_ = data[at + 4 : at + 4 + n].decode()
            at += 4 + n
            (n,) = struct.unpack_from("<I", data, at)
            vector = list(struct.unpack_from(f"<{n}f", data, at + 4))
            at += 4 + 4 * n
            (n,) = struct.unpack_from("<I", data, at)
            meta = data[at + 4 : at + 4 + n]
            if len(meta) < n:
                raise ValueError("a record is cut short")
            at += 4 + n
            yield id_, vector, meta.decode() or None
    except struct.error as e:
        raise ValueError("a record is cut short") from e


def folder(path: str) -> str:
    """The plain path of a folder that driver and executors see alike; an error for a store that needs a client."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://?", path) and not path.startswith("file:"):
        raise ValueError(f"vector-records writes to a folder that all executors share, not to {path}")
    return re.sub("^file:/*", "/", path)


@dataclass
class Part(InputPartition):
    path: str


class Reader(DataSourceReader):
    """One partition a file, in a folder that all executors share. ``formats.read_binary`` reads any store."""

    def __init__(self, options: dict):
        self.path, self.magic = folder(options["path"]), options.get("magic", MAGIC.decode()).encode()

    def partitions(self) -> list[Part]:
        return [Part(p) for p in (sorted(glob.glob(f"{self.path}/*.bin")) if os.path.isdir(self.path) else [self.path])]

    def read(self, partition: Part) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from unpacked(f.read(), self.magic)


@dataclass
class Done(WriterCommitMessage):
    paths: list[str]


class Writer(DataSourceWriter):
    """Files of FILE_BYTES at most, or of one record, which get their names when the job is committed."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.magic, self.overwrite = folder(options["path"]), options.get("magic", MAGIC.decode()).encode(), overwrite

    def write(self, iterator) -> Done:
        os.makedirs(self.path, exist_ok=True)
        paths: list[str] = []
        held: list[bytes] = []
        size = 0

        def put() -> None:
            paths.append(f"{self.path}/.part-{uuid.uuid4().hex}.new")
            with open(paths[-1], "wb") as f:
                f.write(self.magic + struct.pack("<IQ", VERSION, len(held)) + b"".join(held))

        for row in iterator:
            record = packed(row[0], list(row[1]), row[2])
            if held and size + len(record) > FILE_BYTES:
                put()
                held, size = [], 0
            held.append(record)
            size += len(record)
        if held or not paths:
            put()
        return Done(paths)

    def commit(self, messages) -> None:
        old = glob.glob(f"{self.path}/*.bin") if self.overwrite else []
        for k, p in enumerate(p for m in messages if m for p in m.paths):
            os.rename(p, f"{self.path}/part-{k:05d}-{uuid.uuid4().hex[:8]}.bin")
        for p in old:
            os.remove(p)

    def abort(self, messages) -> None:
        for p in (p for m in messages if m for p in m.paths):
            if os.path.exists(p):
                os.remove(p)


class VectorRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector-records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorRecords)
