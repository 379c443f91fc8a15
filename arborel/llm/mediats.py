"""Media columns: byte payloads as MPEG transport streams (ISO/IEC 13818-1).

A payload becomes a stream of 188-byte packets: a program association table,
a program map table, and elementary packets with presentation timestamps on
one stream of private data.  Each elementary packet holds one unit of samples
and begins at a random-access point.  Reading parses the tables, checks their
checksums and the continuity counters, drops repeated packets, and reassembles
the payload; whatever is damaged is counted and never an error.  Time stamps
and random-access points are columns beside the stream, so that a place in
time is reached without reading what comes before it.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pieces

PACKET, SYNC = 188, 0x47
#: Identifiers of the streams written here; reading takes them from the tables.
MAP_PID, DATA_PID, PROGRAM, PRIVATE_STREAM, PRIVATE_TYPE = 0x1000, 0x0100, 1, 0xBD, 0x06
#: Samples in an elementary packet, samples a second, and ticks of the clock a second.
UNIT, SAMPLES_S, TICKS_S = 192 * 64, 8000, 90_000


@functools.lru_cache(64)
def section_crc(data: bytes) -> int:
    """The tables' checksum: polynomial 0x04C11DB7, from all ones, not reflected."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


@functools.lru_cache(4)
def _tables() -> bytes:
    association = _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | MAP_PID))
    program = _section(2, PROGRAM, struct.pack(">HH", 0xE000 | DATA_PID, 0xF000) + struct.pack(">BHH", PRIVATE_TYPE, 0xE000 | DATA_PID, 0xF000))
    return b"".join(struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + s + b"\xff" * (PACKET - 5 - len(s)) for pid, s in ((0, association), (MAP_PID, program)))


def _stamp(mark: int, t: int) -> bytes:
    return bytes((mark << 4 | (t >> 29 & 0x0E) | 1, t >> 22 & 0xFF, (t >> 14 & 0xFE) | 1, t >> 7 & 0xFF, (t << 1 & 0xFE) | 1))


def write_stream(payload: bytes) -> bytes:
    """A transport stream that holds the payload."""
    out, counter = [_tables()], 0
    for at in range(0, len(payload), UNIT):
        data = payload[at : at + UNIT]
        ticks = at * TICKS_S // SAMPLES_S & (1 << 33) - 1
        pes = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(data) + 8, 0x84, 0x80, 5) + _stamp(2, ticks) + data
        clock = struct.pack(">IH", ticks >> 1, (ticks & 1) << 15 | 0x7E00)
        room = PACKET - 12
        first = pes[:room]
        stuffing = room - len(first)
        out.append(struct.pack(">BHBBB", SYNC, 0x4000 | DATA_PID, 0x30 | counter, 7 + stuffing, 0x50) + clock + b"\xff" * stuffing + first)
        counter = counter + 1 & 15
        whole, rest = divmod(len(pes) - len(first), PACKET - 4)
        if whole:
            packets = np.empty((whole, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
            packets[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
            packets[:, 4:] = np.frombuffer(pes, np.uint8, whole * (PACKET - 4), room).reshape(whole, -1)
            out.append(packets.tobytes())
            counter = counter + whole & 15
        if rest:
            extra = PACKET - 5 - rest  # bytes of the adaptation field after its length
            field_ = b"" if not extra else b"\0" + b"\xff" * (extra - 1)
            out.append(struct.pack(">BHBB", SYNC, DATA_PID, 0x30 | counter, extra) + field_ + pes[-rest:])
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes = b""
    packets: int = 0
    lost: int = 0  # breaks of the continuity counter
    repeated: int = 0  # packets that are sent twice, which the standard allows
    faulty: int = 0  # no valid tables, packets marked as damaged, elementary packets that are cut short or no such
    stamps: list[int] = field(default_factory=list)
    #: (time stamp, place of the first packet in the stream, offset in the payload) of each random-access point
    points: list[tuple[int, int, int]] = field(default_factory=list)


def _starts(packets: np.ndarray) -> np.ndarray:
    """Where the payload of each packet begins; the packet's end if it has none."""
    control = packets[:, 3]
    start = np.where(control & 0x20 > 0, packets[:, 4].astype(np.int32) + 5, 4)
    return np.where(control & 0x10 > 0, np.minimum(start, PACKET), PACKET)


def _read_section(packets: np.ndarray, pids: np.ndarray, pid: int, table: int) -> bytes | None:
    """The first whole section of a table on a PID, without its checksum; it can go on over several packets."""
    own = packets[pids == pid]
    start = _starts(own)
    opens = np.flatnonzero((own[:, 1] & 0x40 > 0) & (start < PACKET))
    for head, end in zip(opens.tolist(), [*opens[1:].tolist(), len(own)], strict=False):
        data = b"".join(own[i, start[i] :].tobytes() for i in range(head, min(end, head + 8)))
        begin = 1 + data[0]
        if begin + 3 > len(data):
            continue
        size = 3 + (struct.unpack_from(">H", data, begin + 1)[0] & 0x0FFF)
        section = data[begin : begin + size]
        if len(section) == size >= 12 and section[0] == table and section_crc(section[:-4]) == struct.unpack(">I", section[-4:])[0]:
            return section[:-4]
    return None


def _elementary_pid(packets: np.ndarray, pids: np.ndarray) -> int | None:
    """The PID of the first stream of the first program, by the association and map tables."""
    association = _read_section(packets, pids, 0, 0)
    if association is None:
        return None
    entries = association[8 : 8 + (len(association) - 8) // 4 * 4]
    maps = [p & 0x1FFF for n, p in struct.iter_unpack(">HH", entries) if n]
    program = _read_section(packets, pids, maps[0], 2) if maps else None
    if program is None:
        return None
    at = 12 + (struct.unpack_from(">H", program, 10)[0] & 0x0FFF) if len(program) >= 12 else len(program)
    return struct.unpack_from(">BHH", program, at)[1] & 0x1FFF if at + 5 <= len(program) else None


def read_stream(media: bytes) -> Stream:
    """Parse a transport stream, of one program with one private stream.

    Packets without the sync byte are skipped; a stream without valid tables
    gives no payload and one fault.  An elementary packet that is not whole
    gives no payload and a fault.
    """
    found = Stream()
    packets = np.frombuffer(media, np.uint8, len(media) // PACKET * PACKET).reshape(-1, PACKET)
    slots = np.flatnonzero(packets[:, 0] == SYNC)
    found.packets = len(slots)
    damaged = packets[slots, 1] & 0x80 > 0
    found.faulty = int(damaged.sum())
    slots = slots[~damaged]
    packets = packets[slots]
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    pid = _elementary_pid(packets, pids)
    if pid is None:
        found.faulty += 1
        return found
    own = np.flatnonzero(pids == pid)
    own = own[packets[own, 3] & 0x10 > 0]  # others carry nothing and do not count
    counters = (packets[own, 3] & 15).astype(np.int32)
    starts = _starts(packets[own])
    again = np.zeros(len(own), bool)
    for i in (np.flatnonzero(np.diff(counters) == 0) + 1).tolist():
        # A clock in front of the payload may differ.
        again[i] = not again[i - 1] and starts[i] == starts[i - 1] and (packets[own[i], starts[i] :] == packets[own[i - 1], starts[i] :]).all()
    found.repeated = int(again.sum())
    own, counters, start = own[~again], counters[~again], starts[~again]
    stream = packets[own]
    noted = (stream[:, 3] & 0x20 > 0) & (stream[:, 4] > 0)
    broken = (np.diff(counters) % 16 != 1) & ~(noted & (stream[:, 5] & 0x80 > 0))[1:]  # a break may be announced
    found.lost = int(broken.sum())
    body = stream[np.arange(PACKET) >= start[:, None]].tobytes()
    offsets = np.concatenate([[0], np.cumsum(PACKET - start)])
    random = noted & (stream[:, 5] & 0x40 > 0)
    heads = np.flatnonzero(stream[:, 1] & 0x40 > 0)
    gaps = np.concatenate([[0], np.cumsum(broken)])
    parts, size = [], 0
    for head, after in zip(heads.tolist(), [*heads[1:].tolist(), len(own)], strict=False):
        begin, end = int(offsets[head]), int(offsets[after])
        # Within an elementary packet no counter breaks.
        if end - begin < 9 or gaps[after - 1] != gaps[head]:
            found.faulty += 1
            continue
        prefix, length, _, flags, extra = struct.unpack_from(">IHBBB", body, begin)
        stop = begin + 6 + length if length else end
        if prefix >> 8 != 1 or stop > end or begin + 9 + extra > stop or flags & 0x80 and extra < 5:
            found.faulty += 1
            continue
        stamp = 0
        if flags & 0x80:
            a, b, c = struct.unpack_from(">BHH", body, begin + 9)
            stamp = (a >> 1 & 7) << 30 | b >> 1 << 15 | c >> 1
            found.stamps.append(stamp)
        if random[head]:
            found.points.append((stamp, int(slots[own[head]]), size))
        parts.append(body[begin + 9 + extra : stop])
        size += stop - begin - 9 - extra
    found.payload = b"".join(parts)
    return found


def from_point(media: bytes, points: list[tuple[int, int, int]], ticks: int) -> bytes:
    """The payload from the last random-access point at or before a time stamp.

    points are those of the stream's index.  Only the tables, which stand
    before the first point, and what begins at the point are read.
    """
    before = [p for p in points if p[0] <= ticks]
    if not before:
        return read_stream(media).payload
    head = min(p[1] for p in points) * PACKET
    return read_stream(media[:head] + media[before[-1][1] * PACKET :]).payload


def padded(raw: bytes, multiple: int = 192) -> bytes:
    """Bytes 32 appended up to a positive multiple."""
    return raw + b" " * (-len(raw) % multiple if raw else multiple)


def _batches(column: int, out: pa.Schema, make):
    """Apply make (a row's values -> a row's values) in batches of bounded bytes of a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in pieces(batch, column):
                made = [make(*r) for r in zip(*(c.to_pylist() for c in batch.slice(a, b - a).columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    return run


def _store(key, text):
    raw = b"" if text is None else text.encode()
    return key, len(raw), write_stream(padded(raw))


def to_media(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, n_bytes, media (the transport stream).

    Null and empty texts store 192 spaces.  Ids may be null or repeat; other
    columns are not read.  A text is held in memory whole, with its stream.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_batches(1, out, _store), "doc_id long, n_bytes long, media binary")


def _features(key, n, media):
    s = read_stream(media)
    stamps = f"{s.stamps[0]}-{s.stamps[-1]}" if s.stamps else "none"
    feature = f"packets={s.packets};units={len(s.stamps)};points={len(s.points)};pts={stamps};lost={s.lost};repeated={s.repeated};faulty={s.faulty}"
    points = [{"pts": t, "packet": p, "offset": o} for t, p, o in s.points]
    return key, n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, s.stamps, points


def media_features(media: DataFrame) -> DataFrame:
    """Read the streams of to_media back and describe each; a null stream counts as empty.

    Beside digests and a summary: pts, the time stamps of all elementary
    packets, and points, the index of random-access points (pts, packet: its
    place in the stream, offset: in the payload).
    """
    point = pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64()), ("offset", pa.int64())]))
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pts", pa.list_(pa.int64())), ("points", point)])
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, points array<struct<pts: long, packet: long, offset: long>>"
    return media.select("doc_id", "n_bytes", F.coalesce("media", F.lit(b"")).alias("media")).mapInArrow(_batches(2, out, _features), schema)
