"""Media columns: payloads stored as MPEG transport streams and parsed back.

``mux`` wraps a payload of 8-bit samples into 188-byte packets: a program association
table, a program map table, and one elementary stream of PES packets with presentation
timestamps (90 kHz) and clock references at its random-access points.  ``demux`` works on
any stream of this kind: it follows the tables (sections may span packets; their CRC is
checked), checks every stream's continuity counters (a packet may be sent twice, a marked
discontinuity is none), reassembles PES packets and gives timestamps with the random-access
points.  PES packets that are broken or cut short are counted and left out or kept as far
as they go.

Nulls: a null or empty text is one unit of filler; a null doc_id stays null.  Equal
texts give equal bytes, and repeated rows equal rows.  Bytes that are no transport stream,
and streams without a program, give a row with ``error`` and no payload.  An empty table
gives an empty table.  Very long texts are streams of their own, one in memory at a time.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from draftmetrics.llm.shared import table, text_slices, tidied

PACKET, PMT_PID, ES_PID, STREAM_TYPE, STREAM_ID = 188, 0x1000, 0x100, 0x06, 0xBD
#: Payload unit in bytes, its duration in 90 kHz ticks (8-bit samples at 48 kHz), units in a PES packet, PES packets from one random-access point to the next.
UNIT, UNIT_TICKS, PES_UNITS, RANDOM_ACCESS_EVERY = 576, 1080, 8, 4


def _section_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
            crc &= 0xFFFFFFFF
    return crc


def _table_packet(pid: int, table_id: int, body: bytes, counter: int) -> bytes:
    section = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, 0, 1, 0xC1, 0, 0]) + body
    section += _section_crc(section).to_bytes(4, "big")
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0]) + section).ljust(PACKET, b"\xff")


@lru_cache(maxsize=32)
def _tables(counter: int) -> np.ndarray:
    pat = _table_packet(0, 0, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]), counter)
    pmt = _table_packet(PMT_PID, 2, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0]), counter)
    return np.frombuffer(pat + pmt, np.uint8).reshape(2, PACKET)


@lru_cache(maxsize=256)
def _shape(pes_bytes: int, random_access: bool) -> tuple[np.ndarray, np.ndarray]:
    """Packets of a PES packet without its bytes, counters and clock reference, and where its bytes go."""
    packets, left, first = [], pes_bytes, True
    while left:
        extra = 8 if first and random_access else 0  # length, flags, clock reference
        n = min(left, PACKET - 4 - extra)
        gap = PACKET - 4 - n  # bytes of adaptation field
        row = np.full(PACKET, 255, np.uint8)
        row[:4] = 0x47, (0x40 if first else 0) | ES_PID >> 8, ES_PID & 255, 0x30 if gap else 0x10
        if gap:
            row[4] = gap - 1
            if gap > 1:
                row[5] = 0x50 if extra else 0
        packets.append((row, np.arange(PACKET) >= PACKET - n))
        left, first = left - n, False
    return np.stack([p for p, _ in packets]), np.stack([m for _, m in packets])


def mux(payload: bytes) -> bytes:
    """A transport stream that carries ``payload`` (its length a positive multiple of UNIT)."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload is not whole units")
    out, counter, tables = [], 0, 0
    for k, a in enumerate(range(0, len(payload), UNIT * PES_UNITS)):
        part, access = payload[a : a + UNIT * PES_UNITS], k % RANDOM_ACCESS_EVERY == 0
        if access:
            out.append(_tables(tables & 15))
            tables += 1
        pts = (k * PES_UNITS * UNIT_TICKS) & ((1 << 33) - 1)
        size = len(part) + 8
        head = bytes([0, 0, 1, STREAM_ID, size >> 8, size & 255, 0x80, 0x80, 5, 0x21 | (pts >> 30) << 1, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1])
        rows, mask = _shape(len(head) + len(part), access)
        rows = rows.copy()
        rows[mask] = np.frombuffer(head + part, np.uint8)
        if access:  # base in 33 bits, 6 reserved ones, extension 0
            rows[0, 6:12] = np.frombuffer((pts << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
        rows[:, 3] |= ((counter + np.arange(len(rows))) & 15).astype(np.uint8)
        counter += len(rows)
        out.append(rows)
    return np.concatenate(out).tobytes()


@dataclass
class Stream:
    """One elementary stream of a transport stream."""

    pid: int
    stream_type: int
    data: bytes = b""
    continuity_errors: int = 0
    damaged: int = 0  #: PES packets that are broken (left out) or cut short
    repeated: int = 0  #: packets sent a second time
    pts: list[int] = field(default_factory=list)  #: of each PES packet (-1: none)
    pes_offset: list[int] = field(default_factory=list)  #: of each PES packet's first byte in ``data``
    random_access: list[int] = field(default_factory=list)  #: numbers of PES packets that are random-access points
    clock: list[int] = field(default_factory=list)  #: clock references (base, 90 kHz)


def _payload_start(rows: np.ndarray) -> np.ndarray:
    """Where each packet's payload begins; PACKET where it has none."""
    start = 4 + np.where(rows[:, 3] & 0x20, 1 + rows[:, 4].astype(np.int64), 0)
    return np.where(rows[:, 3] & 0x10, np.minimum(start, PACKET), PACKET)


def _sections(rows: np.ndarray, table_id: int) -> Iterator[bytes]:
    """Whole sections of a table with a right CRC, from one PID's packets."""
    held = b""
    for row, start in zip(rows, _payload_start(rows).tolist()):
        body = row[start:].tobytes()
        if not body:
            continue
        parts = [body]
        if row[1] & 0x40:  # the pointer says where the next section begins
            parts = [body[1 : 1 + body[0]], body[1 + body[0] :]]
        elif not held:
            continue
        for k, part in enumerate(parts):
            held = part if k == 1 else held + part if held else b""
            while len(held) > 3 and held[0] != 0xFF:
                size = 3 + ((held[1] & 15) << 8 | held[2])
                if size > len(held):
                    break
                section, held = held[:size], held[size:]
                if section[0] == table_id and size >= 12 and _section_crc(section[:-4]) == int.from_bytes(section[-4:], "big"):
                    yield section
            if held[:1] == b"\xff":  # filler
                held = b""


@lru_cache(maxsize=64)
def _programs(raw: bytes) -> tuple[int, ...]:
    found = []
    for s in _sections(np.frombuffer(raw, np.uint8).reshape(-1, PACKET), 0):
        found += [(s[i + 2] & 31) << 8 | s[i + 3] for i in range(8, len(s) - 7, 4) if s[i] << 8 | s[i + 1]]
    return tuple(dict.fromkeys(found))


@lru_cache(maxsize=64)
def _streams(raw: bytes) -> tuple[tuple[int, int], ...]:
    found = []
    for s in _sections(np.frombuffer(raw, np.uint8).reshape(-1, PACKET), 2):
        at = 12 + ((s[10] & 15) << 8 | s[11])
        while at + 5 <= len(s) - 4:
            found.append(((s[at + 1] & 31) << 8 | s[at + 2], s[at]))
            at += 5 + ((s[at + 3] & 15) << 8 | s[at + 4])
    return tuple(dict.fromkeys(found))


def _distinct(packets: np.ndarray) -> bytes:
    """A table's packets; where each holds whole sections, without repeats, which differ in their counters only."""
    rows = packets.copy()
    rows[:, 3] &= 0xF0
    every = [r.tobytes() for r in rows]
    return b"".join(dict.fromkeys(every) if (rows[:, 1] & 0x40).all() else every)


def demux(media: bytes) -> list[Stream]:
    """Elementary streams that the program tables list."""
    if not media or len(media) % PACKET:
        raise ValueError("not whole packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise ValueError("lost synchronisation")
    pid = (p[:, 1] & 31).astype(np.int64) << 8 | p[:, 2]
    out = []
    for program in _programs(_distinct(p[pid == 0])):
        for es_pid, kind in _streams(_distinct(p[pid == program])):
            out.append(_elementary(p[pid == es_pid], Stream(es_pid, kind)))
    return out


def _repeats(rows: np.ndarray, has_clock: np.ndarray) -> np.ndarray:
    """Which packets are the one before sent once more (clock references may differ)."""
    same = rows[1:] == rows[:-1]
    same[:, 6:12] |= has_clock[1:, None]
    again = np.concatenate([[False], same.all(1) & ((rows[1:, 3] & 0x10) > 0)])
    for k in np.flatnonzero(again[1:] & again[:-1]).tolist():  # a third one is no legal repeat
        again[k + 1] = not again[k]
    return again


#: Streams whose PES packets have no optional header; of these, filler.
_PLAIN_IDS, _FILLER_ID = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}, 0xBE


def _elementary(rows: np.ndarray, stream: Stream) -> Stream:
    if not len(rows):
        return stream
    adapted = ((rows[:, 3] & 0x20) > 0) & (rows[:, 4] > 0)
    flags = np.where(adapted, rows[:, 5], 0)
    has_clock = (flags & 0x10) > 0
    again = _repeats(rows, has_clock)
    stream.repeated = int(again.sum())
    rows, flags, has_clock = rows[~again], flags[~again], has_clock[~again]
    stream.clock = [int.from_bytes(r.tobytes(), "big") >> 15 for r in rows[has_clock, 6:12]]
    carries = (rows[:, 3] & 0x10) > 0
    rows, flags = rows[carries], flags[carries]
    counter = (rows[:, 3] & 15).astype(np.int64)
    stream.continuity_errors = int((((counter[1:] - counter[:-1]) % 16 != 1) & ((flags[1:] & 0x80) == 0)).sum())
    start = _payload_start(rows)
    flat = rows[np.arange(PACKET) >= start[:, None]].tobytes()
    ends = np.cumsum(PACKET - start)
    first = np.flatnonzero((rows[:, 1] & 0x40) > 0)
    begin = (ends - (PACKET - start))[first].tolist()
    parts, size = [], 0
    for k, b, e in zip(first.tolist(), begin, [*begin[1:], len(flat)]):
        h = flat[b : min(e, b + 14)]
        if len(h) < 6 or h[:3] != b"\0\0\1" or (h[3] not in _PLAIN_IDS and len(h) < 9):
            stream.damaged += 1
            continue
        plain = h[3] in _PLAIN_IDS
        skip = 6 if plain else 9 + h[8]
        promised = h[4] << 8 | h[5]
        end = min(e, b + 6 + promised) if promised else e
        stream.damaged += bool(promised and b + 6 + promised > e)
        if h[3] == _FILLER_ID:
            continue
        has_pts = not plain and h[7] >> 7 and len(h) == 14
        if flags[k] & 0x40:
            stream.random_access.append(len(stream.pts))
        stream.pts.append((h[9] >> 1 & 7) << 30 | h[10] << 22 | (h[11] >> 1) << 15 | h[12] << 7 | h[13] >> 1 if has_pts else -1)
        stream.pes_offset.append(size)
        parts.append(flat[b + skip : end])
        size += len(parts[-1])
    stream.data = b"".join(parts)
    return stream


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled with 255 to whole units, as a transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1), 4 << 20):
                raw = [(t or "").encode() for t in texts]
                media = [mux(x + b"\xff" * (max(UNIT, -(-len(x) // UNIT) * UNIT) - len(x))) for x in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(tidied(run), "doc_id long, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access_pts array<long>, continuity_errors long, error string"


def features(blob: bytes | None) -> dict:
    """One stored stream parsed, by its first elementary stream; what does not parse has ``error``."""
    out: dict = dict.fromkeys(x.split()[0] for x in FEATURES.split(", "))
    if blob is None:
        return out | {"error": "no media"}
    out |= {"media_bytes": len(blob), "media_sha256": hashlib.sha256(blob).hexdigest()}
    try:
        streams = demux(blob)
    except ValueError as e:
        return out | {"error": str(e)}
    if not streams:
        return out | {"error": "no program"}
    s = streams[0]
    samples = np.frombuffer(s.data, np.uint8)
    access = [s.pts[k] for k in s.random_access]
    first, last = (s.pts[0], s.pts[-1]) if s.pts else (-1, -1)
    mean = int(samples.sum(dtype=np.int64)) * 1000 // max(1, len(samples))
    feature = f"pid={s.pid};type={s.stream_type};packets={len(blob) // PACKET};pes={len(s.pts)};cc_errors={s.continuity_errors};damaged={s.damaged};first_pts={first};last_pts={last};rap={len(access)};pcr={len(s.clock)};mean={mean}"
    return out | {
        "payload_bytes": len(s.data), "payload_sha256": hashlib.sha256(s.data).hexdigest(), "tail_crc32": zlib.crc32(s.data[-32:]),
        "feature": feature, "pts": s.pts, "random_access_pts": access, "continuity_errors": s.continuity_errors,
    }


def media_features(media: DataFrame) -> DataFrame:
    """Stored streams (doc_id, n_bytes, media) parsed: payload, timestamps and random-access points of the first elementary stream."""
    ddl = f"doc_id long, n_bytes long, {FEATURES}"
    schema = to_arrow_schema(StructType.fromDDL(FEATURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, blobs in text_slices(batch.column(2), 8 << 20):
                found = pa.RecordBatch.from_pylist([features(x) for x in blobs], schema=schema)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 1)), *found.columns], names=["doc_id", "n_bytes", *schema.names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidied(run), ddl)


def media_roundtrip(docs: DataFrame) -> DataFrame:
    """Store every text as a transport stream, read the stored streams and parse them."""
    return media_features(table(to_media(docs), "media-ts"))
