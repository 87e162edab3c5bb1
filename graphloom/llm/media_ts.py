"""Media columns: MPEG transport streams.

``mux`` stores a payload losslessly as access units of 8-bit samples: each unit is one elementary
packet (PES) with a time stamp, cut into 188-byte transport packets after a program association
and a program map table. ``demux`` reads such bytes back: it parses the program tables (with their
CRC), checks each PID's continuity counter, reassembles the elementary packets and returns time
stamps with the random-access points. Every row is handled by itself: no shuffle, no skew.

Defined cases: null text is the empty text; a payload is the UTF-8 text with bytes 0 up to a
positive multiple of 64, so the empty text gives 64 bytes 0; equal texts give equal values;
repeated rows give one row each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.llm.common import map_batches, text_of

PACKET, UNIT, RAP_EVERY, TICKS = 188, 8192, 8, 3600
PMT_PID, ES_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x100, 0x101, 1, 0x06, 0xBD


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        table.append(c & 0xFFFFFFFF)
    return table


CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


PAT = _table_packet(0, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)))
PMT = _table_packet(PMT_PID, _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, STREAM_TYPE, 0xE000 | ES_PID, 0xF000)))


def _stamp(t: int) -> bytes:
    return bytes([0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, 0x01 | (t >> 14) & 0xFE, (t >> 7) & 0xFF, 0x01 | (t << 1) & 0xFE])


def mux(payload: bytes) -> bytes:
    out, counter = [PAT, PMT], 0
    heads = [struct.pack(">BHB", 0x47, ES_PID, 0x10 | c) for c in range(16)]
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit, t = payload[at : at + UNIT], k * TICKS & 0x1FFFFFFFF
        pes = struct.pack(">IHBBB", 0x100 | STREAM_ID, len(unit) + 8, 0x84, 0x80, 5) + _stamp(t) + unit
        extra = b""
        if k % RAP_EVERY == 0:  # random access, with the clock: 33 bits, 6 reserved, 9 of extension
            extra = b"\x50" + ((t << 15) | 0x7E00).to_bytes(6, "big")
        i, first = 0, True
        while i < len(pes):
            room = PACKET - 4 - (len(extra) + 1 if extra else 0)
            part = pes[i : i + room]
            i += len(part)
            if not extra and not first and len(part) == room:
                out.append(heads[counter] + part)
            else:
                head = struct.pack(">BH", 0x47, (0x4000 if first else 0) | ES_PID)
                if extra or len(part) < room:
                    size = PACKET - 5 - len(part)
                    field_ = (extra or (b"\0" if size else b"")).ljust(size, b"\xff")
                    out.append(head + bytes([0x30 | counter, size]) + field_ + part)
                else:
                    out.append(head + bytes([0x10 | counter]) + part)
            counter, first, extra = (counter + 1) & 15, False, b""
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes = b""
    units: list[tuple[int, int, int, bool]] = field(default_factory=list)  # time stamp, offset in the payload, packet, random access
    packets: int = 0
    continuity_errors: int = 0
    table_errors: int = 0
    stream_type: int = -1


def _read_section(packet: bytes, at: int, stream: Stream) -> tuple[int, bytes] | None:
    at += 1 + packet[at]
    size = struct.unpack_from(">H", packet, at + 1)[0] & 0x0FFF
    section = packet[at : at + 3 + size]
    if len(section) < 12 or crc32_mpeg(section):
        stream.table_errors += 1
        return None
    return section[0], section[8:-4]


def demux(data: bytes) -> Stream:
    """Reads a stream of one program; damaged packets and tables are counted, not fatal."""
    s = Stream(packets=len(data) // PACKET)
    pmt_pid = es_pid = -1
    last: dict[int, int] = {}
    parts: list[bytes] = []
    opened: tuple[int, bool] | None = None
    done: list[tuple[bytes, int, bool]] = []
    for k in range(s.packets):
        at = k * PACKET
        sync, flags, third = struct.unpack_from(">BHB", data, at)
        if sync != 0x47:
            s.continuity_errors += 1
            continue
        pid, start, control, counter = flags & 0x1FFF, flags & 0x4000, third >> 4 & 3, third & 15
        body, access = at + 4, False
        if control & 2:
            size = data[at + 4]
            access = bool(size and data[at + 5] & 0x40)
            body += 1 + size
        if not control & 1:
            continue
        if pid in last:
            if counter == last[pid]:  # a repeated packet is legal and carries nothing new
                continue
            if counter != (last[pid] + 1) & 15:
                s.continuity_errors += 1
        last[pid] = counter
        if pid == es_pid:
            if start:
                if opened:
                    done.append((b"".join(parts), *opened))
                parts, opened = [], (k, access)
            if opened:
                parts.append(data[body : at + PACKET])
        elif start and pid in (0, pmt_pid):
            found = _read_section(data[at : at + PACKET], body - at, s)
            if found and found[0] == 0 and pid == 0:
                pmt_pid = struct.unpack_from(">H", found[1], 2)[0] & 0x1FFF
            elif found and found[0] == 2:
                skip = 4 + (struct.unpack_from(">H", found[1], 2)[0] & 0x0FFF)
                s.stream_type = found[1][skip]
                es_pid = struct.unpack_from(">H", found[1], skip + 1)[0] & 0x1FFF
    if opened:
        done.append((b"".join(parts), *opened))
    chunks, offset = [], 0
    for pes, k, access in done:
        if len(pes) < 9 or pes[:3] != b"\0\0\1":
            s.continuity_errors += 1
            continue
        size = struct.unpack_from(">H", pes, 4)[0]
        a, b, c, d, e = pes[9:14] if pes[7] & 0x80 else (0,) * 5
        stamp = (a >> 1 & 7) << 30 | b << 22 | (c >> 1) << 15 | d << 7 | e >> 1
        unit = pes[9 + pes[8] : 6 + size if size else None]
        s.units.append((stamp, offset, k, access))
        chunks.append(unit)
        offset += len(unit)
    s.payload = b"".join(chunks)
    return s


def payload_of(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data + b"\0" * ((-len(data) % 64) if data else 64)


def feature_of(s: Stream) -> str:
    """units, random-access points, last time stamp, errors, stream type, checksum (Adler-32) and peak sample."""
    raps = [u for u in s.units if u[3]]
    return f"units={len(s.units)};rap={len(raps)};last_rap_packet={raps[-1][2] if raps else -1};last_pts={s.units[-1][0] if s.units else -1};cc={s.continuity_errors};psi={s.table_errors};type={s.stream_type};sum={zlib.adler32(s.payload)};peak={max(s.payload, default=0)}"


INDEX = T.ArrayType(T.StructType([T.StructField("pts", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("packet", T.LongType()), T.StructField("random_access", T.BooleanType())]))


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", outputs: bool = True) -> DataFrame:
    """The digests of each row's stored stream; with ``outputs`` also the stream and its unit index."""
    longs, strings = ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes"), ("payload_sha256", "media_sha256", "feature")
    fields = [T.StructField(id_col, T.LongType()), *(T.StructField(c, T.LongType()) for c in longs), *(T.StructField(c, T.StringType()) for c in strings)]
    if outputs:
        fields += [T.StructField("media", T.BinaryType()), T.StructField("units", INDEX)]

    def make():
        def step(batch):
            out = {f.name: [] for f in fields}
            out[id_col] = batch.column(0)
            for text in batch.column(1).to_pylist():
                media = mux(payload_of(text))
                s = demux(media)
                row = {
                    "n_bytes": len(text.encode("utf-8", "surrogatepass")), "payload_bytes": len(s.payload), "tail_crc32": zlib.crc32(s.payload[-64:]), "media_bytes": len(media),
                    "payload_sha256": hashlib.sha256(s.payload).hexdigest(), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature_of(s),
                    "media": media, "units": [dict(zip(("pts", "offset", "packet", "random_access"), u, strict=True)) for u in s.units],
                }
                for f in fields[1:]:
                    out[f.name].append(row[f.name])
            return out

        return step

    rows = df.select(df[id_col].cast("long").alias(id_col), text_of(df, text_col).alias("text"))
    return map_batches(rows, make, T.StructType(fields))
