"""Media columns: MPEG transport streams, written and read back as binary columns.

``mux`` stores bytes in a single-program stream: a program association table, a program map table, and elementary
packets (PES) with presentation timestamps, each in 188-byte packets whose first one carries a clock reference and the
random-access mark. ``demux`` parses the tables, checks continuity counters, reassembles the elementary packets and
returns the payload with timestamps and random-access points. A damaged stream is reported in its row.

Null text is stored as an empty one, an empty one as one block of padding. Other columns are kept; a column of theirs
that has the name of a result is replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orgbeacon.llm.shared import text_buffers

PACKET = 188
PMT_PID, ES_PID = 0x0100, 0x0101
#: Samples (bytes) of an elementary packet, and the 90 kHz ticks that they last at 8000 samples a second.
FRAME = 3072
TICKS = FRAME * 90000 // 8000
BLOCK = 192
_PES_HEAD = 14

_CRC = np.zeros(256, np.uint64)
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    _CRC[_i] = _c


def _section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) ^ int(_CRC[(c >> 24) ^ b])) & 0xFFFFFFFF
    return c


def _section(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    whole = head + struct.pack(">I", _section_crc(head))
    return (struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10) + b"\x00" + whole).ljust(PACKET, b"\xff")


_TABLES = _section(0, 0x00, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID)) + _section(
    PMT_PID, 0x02, 1, struct.pack(">HH", 0xE000 | ES_PID, 0xF000) + struct.pack(">BHH", 0x06, 0xE000 | ES_PID, 0xF000)
)


def _layout(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The packets of an elementary packet of ``size`` bytes with its head: a template, and where the bytes go in it."""
    room = [PACKET - 4 - 8]
    left = size - room[0]
    while left > 0:
        room.append(PACKET - 4)
        left -= PACKET - 4
    out = np.full((len(room), PACKET), 0xFF, np.uint8)
    places, left = [], size
    for i, most in enumerate(room):
        n = min(most, left)
        left -= n
        extra = PACKET - 4 - n  # of the adaptation field, with its length byte
        out[i, :4] = (0x47, (0x40 if i == 0 else 0) | ES_PID >> 8, ES_PID & 0xFF, 0x30 if extra else 0x10)
        if extra:
            out[i, 4] = extra - 1
            if extra > 1:
                out[i, 5] = 0x50 if i == 0 else 0  # random access, clock reference
        places.append(np.arange(n) + i * PACKET + 4 + extra)
    return out.ravel(), np.concatenate(places)


_layouts: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _stamped(n: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The heads of n elementary packets, and the clock references of their first transport packets."""
    pts = ((first + np.arange(n, dtype=np.int64)) * TICKS) & ((1 << 33) - 1)
    head = np.zeros((n, _PES_HEAD), np.uint8)
    head[:, :9] = (0, 0, 1, 0xBD, 0, 0, 0x80, 0x80, 5)
    head[:, 9] = 0x21 | (pts >> 30 & 7) << 1
    head[:, 10] = pts >> 22 & 0xFF
    head[:, 11] = pts >> 14 & 0xFE | 1
    head[:, 12] = pts >> 7 & 0xFF
    head[:, 13] = pts << 1 & 0xFE | 1
    clock = np.zeros((n, 6), np.uint8)
    for i in range(4):
        clock[:, i] = pts >> (25 - 8 * i) & 0xFF
    clock[:, 4] = (pts & 1) << 7 | 0x7E
    return head, clock


def mux(payload: np.ndarray) -> bytes:
    """The transport stream of a payload of bytes."""
    parts, done = [np.frombuffer(_TABLES, np.uint8)], 0
    full, rest = divmod(len(payload), FRAME)
    packets = 0
    for count, size in ((full, FRAME), (1, rest)):
        if not count or not size:
            continue
        if size not in _layouts:
            _layouts[size] = _layout(size + _PES_HEAD)
        template, places = _layouts[size]
        head, clock = _stamped(count, done // FRAME)
        head[:, 4], head[:, 5] = (size + _PES_HEAD - 6) >> 8, (size + _PES_HEAD - 6) & 0xFF
        out = np.repeat(template[None, :], count, axis=0)
        out[:, places[:_PES_HEAD]] = head
        out[:, places[_PES_HEAD:]] = payload[done : done + count * size].reshape(count, size)
        out[:, 6:12] = clock
        out = out.reshape(-1, PACKET)
        out[:, 3] |= ((packets + np.arange(len(out))) & 15).astype(np.uint8)
        packets += len(out)
        parts.append(out.ravel())
        done += count * size
    return np.concatenate(parts).tobytes()


def _tables_of(stream: np.ndarray, pid: np.ndarray, which: int) -> bytes:
    """The body of the first section of a pid, its checksum verified."""
    at = np.flatnonzero((pid == which) & ((stream[:, 1] & 0x40) != 0))
    if not len(at):
        raise ValueError(f"no section on pid {which:#x}")
    packet = stream[at[0]].tobytes()
    begin = 5 + packet[4] if packet[3] & 0x20 == 0 else 6 + packet[4] + packet[5 + packet[4]]
    size = (packet[begin + 1] & 0x0F) << 8 | packet[begin + 2]
    whole = packet[begin : begin + 3 + size]
    if _section_crc(whole):
        raise ValueError(f"bad checksum on pid {which:#x}")
    return whole[8:-4]


def _continuity(own: np.ndarray) -> tuple[np.ndarray, int]:
    """Which packets of one elementary stream carry new payload, and how many breaks their counters show.

    Packets without payload don't count; one repeat of a packet is legal and is left out; a marked discontinuity is no break.
    """
    field = (own[:, 3] & 0x20) != 0
    loaded = np.flatnonzero((own[:, 3] & 0x10) != 0)
    if len(loaded) < 2:
        return loaded, 0
    step = np.diff(own[loaded, 3] & 15) & 15
    same = (step == 0) & (own[loaded[1:], 4:] == own[loaded[:-1], 4:]).all(axis=1)
    twice = same & ~np.append(False, same[:-1])
    marked = (field & (own[:, 4] > 0) & ((own[:, 5] & 0x80) != 0))[loaded[1:]]
    fresh = np.append(True, ~twice)
    kept = loaded[fresh]
    step = np.diff(own[kept, 3] & 15) & 15
    return kept, int(((step != 1) & ~marked[fresh[1:]]).sum())


def demux(media: bytes, stream: int = 0) -> dict:
    """Of one elementary stream (by its place in the map table): payload, timestamps (90 kHz), their byte positions, random-access points
    (packet numbers) and continuity errors; and all (pid, stream type) of the map table. Damage raises a ValueError."""
    if len(media) % PACKET:
        raise ValueError("not whole packets")
    s = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (s[:, 0] != 0x47).any():
        raise ValueError("lost synchronisation")
    pid = (s[:, 1].astype(np.int32) & 0x1F) << 8 | s[:, 2]
    programs = _tables_of(s, pid, 0)
    maps = [p & 0x1FFF for n, p in struct.iter_unpack(">HH", programs) if n]
    if not maps:
        raise ValueError("no program")
    pmt = _tables_of(s, pid, maps[0])
    at, streams = 4 + (struct.unpack_from(">H", pmt, 2)[0] & 0x0FFF), []
    while at + 5 <= len(pmt):
        kind, es, size = struct.unpack_from(">BHH", pmt, at)
        streams.append((es & 0x1FFF, kind))
        at += 5 + (size & 0x0FFF)
    if stream >= len(streams):
        raise ValueError(f"no elementary stream {stream}")
    es, kind = streams[stream]
    rows = np.flatnonzero(pid == es)
    kept, errors = _continuity(s[rows])
    rows = rows[kept]
    own = s[rows]
    field = (own[:, 3] & 0x20) != 0
    extra = np.where(field, own[:, 4].astype(np.int32) + 1, 0)
    if (extra > PACKET - 4).any():
        raise ValueError("an adaptation field is longer than its packet")
    marked = field & (own[:, 4] > 0) & ((own[:, 5] & 0x40) != 0)
    column = np.arange(PACKET)
    body = own[column[None, :] >= (4 + extra)[:, None]]
    begins = np.flatnonzero((own[:, 1] & 0x40) != 0)
    at = np.concatenate([[0], np.cumsum(PACKET - 4 - extra)])[begins].astype(np.int64)
    if len(at) and at[-1] + _PES_HEAD > len(body):
        raise ValueError("an elementary packet is not whole")
    heads = body[at[:, None] + np.arange(_PES_HEAD)].astype(np.int64)
    if len(at) and ((heads[:, :3] != (0, 0, 1)).any() or ((heads[:, 7] & 0x80) == 0).any()):
        raise ValueError("not an elementary packet with a timestamp")
    pts = (heads[:, 9] >> 1 & 7) << 30 | heads[:, 10] << 22 | (heads[:, 11] >> 1) << 15 | heads[:, 12] << 7 | heads[:, 13] >> 1
    sizes = (heads[:, 4] << 8 | heads[:, 5]) + 6
    ends = np.append(at[1:], len(body)) if len(at) else at
    if (len(body) and not len(at)) or (sizes != ends - at).any():
        raise ValueError("an elementary packet is not whole")
    keep = np.ones(len(body), bool)
    keep[(at[:, None] + np.arange(_PES_HEAD)).ravel()] = False
    place = np.concatenate([[0], np.cumsum(sizes - _PES_HEAD)])[:-1] if len(at) else at
    return {"payload": body[keep], "stream_type": kind, "streams": streams, "pts": pts, "positions": place, "random_access": rows[marked], "errors": errors}


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a transport stream: the id column, ``n_bytes`` and ``media``. Only the columns named are read."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, 64 * batch.num_rows // max(1, batch.nbytes >> 20))  # about 64 MB of streams at once
            for begin in range(0, batch.num_rows, step):
                rows = batch.slice(begin, step)
                data, at = text_buffers(rows.column(1))
                media = []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    payload = np.full(max(BLOCK, -(-(b - a) // BLOCK) * BLOCK), 32, np.uint8)
                    payload[: b - a] = data[a:b]
                    media.append(mux(payload))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at), pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(write, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_streams(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", n_bytes_col: str = "n_bytes", stream: int = 0) -> DataFrame:
    """What stored streams hold: payload with its digests, timestamps with their random-access packets, continuity errors, pids of all
    elementary streams, and ``damage``: what is wrong with a stream that can't be read, whose other columns are null then.

    A null stream gives nulls.
    """
    schema = "id {}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pts array<long>, random_access array<long>, continuity_errors int, pids array<int>, damage string"
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "pts", "random_access", "continuity_errors", "pids", "damage"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int32()), pa.string()]

    def one(n: int | None, media: bytes | None) -> tuple:
        if media is None:
            return (n, *[None] * 10)
        try:
            got = demux(media, stream)
        except (ValueError, IndexError, struct.error) as wrong:
            return (n, None, None, None, len(media), hashlib.sha256(media).hexdigest(), None, None, None, None, str(wrong))
        payload = got["payload"].tobytes()
        digests = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
        return (n, *digests, got["pts"].tolist(), got["random_access"].tolist(), got["errors"], [p for p, _ in got["streams"]], None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(n, media.as_buffer()) for n, media in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), n_bytes_col, media_col).mapInArrow(read, schema.format(kind)).withColumnRenamed("id", id_col)
