"""Payloads stored as MPEG transport streams, and transport streams read back.

A stream has one program with one private-data elementary stream. Its packets of 188 bytes are
the program association table, the program map table, and the elementary packets, each of which
holds one access unit of at most UNIT bytes with a presentation timestamp. Every RANDOM_ACCESS-th
unit is a random-access point. Stuffing lives in adaptation fields, so that a payload comes back
byte for byte. Reading follows the tables in the stream, checks their sums and the continuity
counters, and reassembles the elementary packets; it does not assume the identifiers used here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import check_columns, whole_text, workers_import

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC = 188, 0x47
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
CLOCK = 90_000
# Choices of the writer.
MAP_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
UNIT, RANDOM_ACCESS, FRAME = 4096, 4, CLOCK // 25
ALIGN = 64


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1) ^ (0x04C11DB7 if value >> 31 else 0)
            value &= 0xFFFFFFFF
        table.append(value)
    return table


def section_crc(data: bytes) -> int:
    """The tables' 32-bit sum; 0 over a section that ends with its own right sum."""
    value, table = 0xFFFFFFFF, _crc_table()
    for byte in data:
        value = (value << 8 & 0xFFFFFFFF) ^ table[value >> 24 ^ byte]
    return value


def _table_packet(pid: int, table_id: int, identifier: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    section = bytes([table_id, 0xB0 | length >> 8, length & 0xFF])
    section += identifier.to_bytes(2, "big") + bytes([0xC1, 0, 0]) + body
    section += section_crc(section).to_bytes(4, "big")
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


@lru_cache(maxsize=1)
def _tables() -> bytes:
    program = PROGRAM.to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big")
    stream = bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    mapped = (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + stream
    return _table_packet(0, 0x00, 1, program) + _table_packet(MAP_PID, 0x02, PROGRAM, mapped)


def _stamp(pts: int) -> bytes:
    return bytes(
        [
            0x21 | pts >> 29 & 0x0E,
            pts >> 22 & 0xFF,
            0x01 | pts >> 14 & 0xFE,
            pts >> 7 & 0xFF,
            0x01 | pts << 1 & 0xFE,
        ]
    )


def write_stream(payload: bytes) -> bytes:
    """The transport stream of a payload; an empty payload gives the tables alone."""
    out, counter = [_tables()], 0
    for number, begin in enumerate(range(0, len(payload), UNIT)):
        unit = payload[begin : begin + UNIT]
        size = 3 + 5 + len(unit)
        pts = number * FRAME % 2**33
        head = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + size.to_bytes(2, "big") + b"\x80\x80\x05"
        data = np.frombuffer(head + _stamp(pts) + unit, dtype=np.uint8)
        random = number % RANDOM_ACCESS == 0
        field = 2 if random else 0  # length and flags of the first packet's adaptation field
        count = 1 + max(0, -(-(len(data) - (184 - field)) // 184))
        packets = np.full((count, PACKET), 0xFF, dtype=np.uint8)
        packets[:, 0] = SYNC
        packets[:, 1] = DATA_PID >> 8
        packets[0, 1] |= 0x40
        packets[:, 2] = DATA_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(count)) % 16
        counter = (counter + count) % 16
        start = np.full(count, 4)
        start[0] += field
        spare = 184 * count - field - len(data)  # goes to the last packet's adaptation field
        start[-1] += spare
        for i in {0, count - 1}:
            length = int(start[i]) - 4
            if length:
                packets[i, 3] |= 0x20
                packets[i, 4] = length - 1
                if length > 1:
                    packets[i, 5] = 0x40 if random and i == 0 else 0
        packets[np.arange(PACKET)[None, :] >= start[:, None]] = data
        out.append(packets.tobytes())
    return b"".join(out)


def _section(packets: np.ndarray, pid: np.ndarray, wanted: int, table_id: int) -> bytes:
    """The first section of a table that lies in one packet."""
    at = np.flatnonzero((pid == wanted) & (packets[:, 1] & 0x40 > 0))
    if not len(at):
        raise ValueError(f"no table on identifier {wanted}")
    data = packets[at[0], 4:].tobytes()
    data = data[1 + data[0] :]
    section = data[: 3 + ((data[1] & 0x0F) << 8 | data[2])]
    if section[0] != table_id or section_crc(section):
        raise ValueError(f"damaged table on identifier {wanted}")
    return section


def read_stream(media: bytes) -> dict:
    """Programs, streams, continuity errors, payload and units of a transport stream.

    A unit has its number, pts, random_access, offset (in the payload) and length.
    """
    packets = np.frombuffer(media, dtype=np.uint8)
    if len(packets) % PACKET or not len(packets):
        raise ValueError("not whole packets")
    packets = packets.reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    pid = (packets[:, 1].astype(np.int64) & 0x1F) << 8 | packets[:, 2]
    programs = _section(packets, pid, 0, 0x00)[8:-4]
    maps = [
        int.from_bytes(programs[i + 2 : i + 4], "big") & 0x1FFF
        for i in range(0, len(programs), 4)
        if programs[i : i + 2] != b"\x00\x00"
    ]
    streams: list[tuple[int, int]] = []
    for identifier in maps:
        body = _section(packets, pid, identifier, 0x02)[8:-4]
        at = 4 + ((body[2] & 0x0F) << 8 | body[3])
        while at < len(body):
            streams.append((int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF, body[at]))
            at += 5 + ((body[at + 3] & 0x0F) << 8 | body[at + 4])
    errors, parts, units, offset = 0, [], [], 0
    for identifier, _ in streams:
        own = packets[pid == identifier]
        control = own[:, 3]
        own, control = own[control & 0x10 > 0], control[control & 0x10 > 0]
        counters = control & 0x0F
        errors += int((np.diff(counters.astype(np.int64)) % 16 != 1).sum())
        has_field = control & 0x20 > 0
        begin = np.where(has_field, 5 + own[:, 4].astype(np.int64), 4)
        random = has_field & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
        data = own[np.arange(PACKET)[None, :] >= begin[:, None]].tobytes()
        ends = np.cumsum(PACKET - begin)
        first = np.flatnonzero(own[:, 1] & 0x40 > 0)
        starts = (ends - (PACKET - begin))[first].tolist()
        for number, (i, a) in enumerate(zip(first.tolist(), starts, strict=True)):
            b = starts[number + 1] if number + 1 < len(starts) else len(data)
            size = int.from_bytes(data[a + 4 : a + 6], "big")
            if data[a : a + 3] != b"\x00\x00\x01" or a + 6 + size != b:
                raise ValueError("damaged elementary packet")
            s = data[a + 9 : a + 14]
            pts = (s[0] & 0x0E) << 29 | s[1] << 22 | (s[2] & 0xFE) << 14 | s[3] << 7 | s[4] >> 1
            unit = data[a + 9 + data[a + 8] : b]
            units.append((number, pts, bool(random[i]), offset, len(unit)))
            offset += len(unit)
            parts.append(unit)
    return {
        "programs": len(maps),
        "streams": len(streams),
        "packets": len(packets),
        "continuity_errors": errors,
        "payload": b"".join(parts),
        "units": units,
    }


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of ALIGN."""
    return data + b"\0" * (ALIGN - len(data) % ALIGN if len(data) % ALIGN or not data else 0)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the whole text in UTF-8) and media (the stream) of each row of docs.

    A null text counts as empty: its payload is 64 bytes 0. Rows are not merged; equal texts
    give equal media.
    """
    check_columns(docs, ("doc_id", "text"))
    workers_import(docs.sparkSession)
    names = ["doc_id", "n_bytes", "media"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                data = part.column(1).to_pylist()
                media = [write_stream(padded(x)) for x in data]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) for x in data], pa.int64()),
                        pa.array(media, pa.binary()),
                    ],
                    names=names,
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary"))
    return source.mapInArrow(write, "doc_id long, n_bytes long, media binary")


_UNITS = "array<struct<number:long,pts:long,random_access:boolean,offset:long,length:long>>"
_READ = (
    "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, "
    f"programs long, streams long, packets long, continuity_errors long, units {_UNITS}"
)
_UNIT_ARROW = pa.list_(
    pa.struct(
        [
            ("number", pa.int64()),
            ("pts", pa.int64()),
            ("random_access", pa.bool_()),
            ("offset", pa.int64()),
            ("length", pa.int64()),
        ]
    )
)


def from_media(stored: DataFrame) -> DataFrame:
    """What `to_media` stored, read back: payload, tables, continuity errors and units.

    Null media give null in every column that is read. A damaged stream is an error.
    """
    check_columns(stored, ("doc_id", "n_bytes", "media"))
    workers_import(stored.sparkSession)
    counted = ("programs", "streams", "packets", "continuity_errors")
    names = ["doc_id", "n_bytes", "payload", "media_bytes", "media_sha256", *counted, "units"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                media = part.column(2).to_pylist()
                found = [read_stream(x) if x is not None else {} for x in media]
                digests = [x if x is None else hashlib.sha256(x).hexdigest() for x in media]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([x.get("payload") for x in found], pa.binary()),
                        pa.array([x if x is None else len(x) for x in media], pa.int64()),
                        pa.array(digests, pa.string()),
                        *(pa.array([x.get(c) for x in found], pa.int64()) for c in counted),
                        pa.array(
                            [_unit_rows(x["units"]) if x else None for x in found], _UNIT_ARROW
                        ),
                    ],
                    names=names,
                )

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read, _READ)


def _unit_rows(units: list[tuple]) -> list[dict]:
    keys = ("number", "pts", "random_access", "offset", "length")
    return [dict(zip(keys, u, strict=True)) for u in units]

