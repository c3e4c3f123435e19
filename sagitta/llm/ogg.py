"""Ogg containers in binary columns: writing, and reading with every check that the format allows.

``mux`` stores a payload as 8-bit samples in one or more logical streams, page by page; ``demux`` walks the pages,
verifies each page's checksum and sequence, reassembles packets from the lacing values (across pages too), separates
the logical streams by serial number and derives times from granule positions.

A null payload is an empty one. Equal payloads give equal bytes: serial numbers are fixed, nothing depends on time. Rows are
independent, so repeated rows give repeated results and an empty table an empty one; payloads of any length are read whole, one
at a time; extra columns are ignored. Bytes that are no such container give a row with an error, not a failed task.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sagitta.llm.common import read, utf8

RATE = 8000
PACKET_BYTES = 4000
STREAMS = 2
HEADER = b"\x80PCMU8\x00\x00"
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """The format's CRC (polynomial 0x04C11DB7, high bit first, from zero) by way of zlib's, which runs low bit first."""
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(body: bytes, lacing: bytes, kind: int, granule: int, serial: int, sequence: int) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, kind, granule, serial, sequence, 0) + bytes([len(lacing)]) + lacing
    page = bytearray(head + body)
    page[22:26] = page_checksum(bytes(page)).to_bytes(4, "little")
    return bytes(page)


def _pages(packets: list[tuple[bytes, int]], serial: int) -> list[tuple[int, bytes]]:
    """A stream's packets, each with its granule position at its end, as pages of at most 255 lacing values.

    The first packet has a page of its own. Each page comes with the granule position at its end (-1: no packet ends).
    """
    out: list[tuple[int, bytes]] = []
    lacing, body, granule, carried = bytearray(), [], -1, False

    def flush(last: bool) -> None:
        nonlocal lacing, body, granule, carried
        kind = carried | (not out) << 1 | last << 2
        out.append((granule, _page(b"".join(body), bytes(lacing), kind, granule, serial, len(out))))
        carried = bool(lacing) and lacing[-1] == 255
        lacing, body, granule = bytearray(), [], -1

    for k, (data, end) in enumerate(packets):
        sizes = [255] * (len(data) // 255) + [len(data) % 255]
        at = 0
        while sizes:
            room = 255 - len(lacing)
            if not room:
                flush(False)
                continue
            part, sizes = sizes[:room], sizes[room:]
            lacing += bytes(part)
            body.append(data[at : at + sum(part)])
            at += sum(part)
        granule = end
        if not k and len(packets) > 1:
            flush(False)
    flush(True)
    return out


def mux(payload: bytes, rate: int = RATE, streams: int = STREAMS, packet: int = PACKET_BYTES) -> bytes:
    """payload as an Ogg file: packets of samples dealt in turn to the logical streams, pages interleaved by time."""
    chunks = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    made = []
    for s in range(streams):
        end, packets = 0, [(HEADER + struct.pack("<III", rate, streams, s), 0)]
        for k in range(s, len(chunks), streams):
            end = k * packet + len(chunks[k])
            packets.append((chunks[k], end))
        made.append(_pages(packets, 0x5A670000 + s))
    first = [p[0][1] for p in made]
    rest = sorted(((g, s, k), page) for s, p in enumerate(made) for k, (g, page) in enumerate(p[1:], 1) if g >= 0)
    if len(rest) != sum(len(p) - 1 for p in made):  # a page in which no packet ends keeps its place in its stream
        rest, queue = [], []
        for s, p in enumerate(made):
            due = 0
            for k, (g, page) in list(enumerate(p))[:0:-1]:
                due = g if g >= 0 else due
                queue.append(((due, s, k), page))
        rest = sorted(queue)
    return b"".join([*first, *(page for _, page in rest)])


def demux(data: bytes) -> dict:
    """What an Ogg file holds: for each serial number its packets and their end positions, with page counts.

    Raises ValueError on a lost capture pattern, a wrong checksum, a gap in a stream's pages or a packet that never ends.
    """
    streams: dict[int, dict] = {}
    at, pages = 0, 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or len(data) < at + 27:
            raise ValueError(f"no page at byte {at}")
        _, version, kind, granule, serial, sequence, crc = struct.unpack_from("<4sBBqIII", data, at)
        n = data[at + 26]
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or end > len(data):
            raise ValueError(f"broken page at byte {at}")
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum at byte {at}")
        s = streams.setdefault(serial, {"packets": [], "granules": [], "open": [], "next": 0, "ended": False})
        if sequence != s["next"] or s["ended"] or bool(kind & 2) != (not sequence) or bool(kind & 1) != bool(s["open"]):
            raise ValueError(f"page {sequence} of stream {serial:x} out of order")
        place, begin, whole = at + 27 + n, at + 27 + n, 0
        for size in lacing:
            place += size
            if size < 255:
                s["packets"].append(b"".join([*s["open"], data[begin:place]]))
                s["open"], begin, whole = [], place, whole + 1
        if begin < place or n and lacing[-1] == 255:
            s["open"].append(data[begin:place])
        s["granules"] += [-1] * (whole - 1) + [granule] * bool(whole)
        s["next"], s["ended"] = sequence + 1, bool(kind & 4)
        at, pages = end, pages + 1
    for serial, s in streams.items():
        if s["open"] or not s["ended"]:
            raise ValueError(f"stream {serial:x} is cut short")
    return {"pages": pages, "streams": streams}


def samples(data: bytes) -> tuple[bytes, dict]:
    """The payload of a file written by ``mux``, and what its pages tell: rate, seconds, streams, packets, pages."""
    found = demux(data)
    parts: dict[int, list[bytes]] = {}
    rate = count = last = 0
    for s in found["streams"].values():
        head = s["packets"][0]
        if head[: len(HEADER)] != HEADER:
            raise ValueError("unknown stream header")
        rate, count, number = struct.unpack_from("<III", head, len(HEADER))
        parts[number] = s["packets"][1:]
        last = max(last, *s["granules"])
    most = max(map(len, parts.values()), default=0)
    payload = b"".join(parts[s][k] for k in range(most) for s in range(count) if k < len(parts[s]))
    if last != len(payload):
        raise ValueError("granule positions and samples differ")
    return payload, {"rate": rate, "seconds": last / rate, "streams": count, "packets": sum(map(len, parts.values())), "pages": found["pages"]}


def feature(payload: bytes, told: dict) -> str:
    """Length in seconds, mean, root mean square about it, crossings of it and peak; then streams, packets, pages."""
    x = np.frombuffer(payload, np.uint8)
    total, square = int(x.sum(dtype=np.int64)), int(np.dot(x.astype(np.int64), x.astype(np.int64)))
    mean = total / len(x)
    over = x > mean
    crossings = int(np.count_nonzero(over[1:] != over[:-1]))
    rms = max(0.0, square / len(x) - mean * mean) ** 0.5
    return f"seconds={told['seconds']:.6f};mean={mean:.4f};rms={rms:.4f};crossings={crossings};peak={int(x.max())};streams={told['streams']};packets={told['packets']};pages={told['pages']}"


def padded(raw: bytes, unit: int = 192) -> bytes:
    return raw + b" " * ((-len(raw)) % unit or unit * (not raw))


def digests(docs: DataFrame) -> DataFrame:
    """For each row the stored form's and the read-back payload's sizes and hashes, and the features."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            data, offs = utf8(batch.column(1))
            raw, rows = data.tobytes(), []
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                media = mux(padded(raw[a:b]))
                payload, told = samples(media)
                rows.append((b - a, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, told)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def decode(files: DataFrame, media: str = "media") -> DataFrame:
    """For each row of a binary column of Ogg files: its other columns with one row for each packet, or one with an error.

    Added columns (they replace ones of those names): serial, packet_no, packet, granule (null where no page ends at
    the packet), seconds of that position at the default rate, error. A null file is an error row.
    """
    kept = [f for f in files.schema.fields if f.name not in {media, "serial", "packet_no", "packet", "granule", "seconds", "error"}]
    schema = T.StructType([*kept, *(T.StructField(n, k) for n, k in (("serial", T.LongType()), ("packet_no", T.LongType()), ("packet", T.BinaryType()), ("granule", T.LongType()), ("seconds", T.DoubleType()), ("error", T.StringType())))])
    names = [f.name for f in kept]
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                base, out = [row[n] for n in names], []
                try:
                    if row[media] is None:
                        raise ValueError("no file")
                    for serial, s in demux(row[media])["streams"].items():
                        for k, (p, g) in enumerate(zip(s["packets"], s["granules"], strict=True)):
                            g = None if g < 0 else g
                            out.append([*base, serial, k, p, g, None if g is None else g / RATE, None])
                except ValueError as e:
                    out = [[*base, None, None, None, None, None, str(e)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return files.select(*(F.col(f"`{n}`") for n in [*names, media])).mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
