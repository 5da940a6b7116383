"""Media columns: MPEG transport streams.

mux() stores bytes as the elementary stream of a one-program transport stream; demux() parses the program
tables, checks continuity counters, reassembles the elementary packets and keeps time stamps with
random-access points. Both work a row at a time, so memory is that of one stream.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import stored, table, texts

PACKET = 188
SYNC = 0x47
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x1000, 0x0100
PROGRAM = 1
PRIVATE_DATA = 0x06  # stream type: PES packets of private data
PRIVATE_STREAM = 0xBD
#: Payload bytes of an elementary packet, and time between two, in 90 kHz ticks.
UNIT_BYTES, UNIT_TICKS = 16_384, 3_600
#: Elementary packets after which the program tables are sent again.
TABLES_EVERY = 32


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


@lru_cache(maxsize=1024)
def crc32_mpeg(data: bytes) -> int:
    c, t = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = (c << 8) & 0xFFFFFFFF ^ t[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


PAT = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + bytes([0x10 | counter, 0]) + section).ljust(PACKET, b"\xff")


def _stamp(mark: int, ticks: int) -> bytes:
    return bytes([mark << 4 | ticks >> 29 & 0x0E | 1, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1])


def mux_bytes(payload: bytes) -> bytes:
    """The payload as a transport stream; every elementary packet starts a random-access point with clock and time stamp."""
    out, counter, tables = [], 0, 0
    first = bytes([SYNC]) + (0x4000 | DATA_PID).to_bytes(2, "big")
    later = bytes([SYNC]) + DATA_PID.to_bytes(2, "big")
    full = [later + bytes([0x10 | c]) for c in range(16)]
    for k, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        if k % TABLES_EVERY == 0:
            out += _table_packet(PAT_PID, tables & 15, PAT), _table_packet(PMT_PID, tables & 15, PMT)
            tables += 1
        unit, ticks = payload[at : at + UNIT_BYTES], k * UNIT_TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, ticks) + unit
        clock = b"\x50" + (ticks << 15 | 0x7E00).to_bytes(6, "big")  # flags: random access, clock
        room = PACKET - 4 - 1 - len(clock)
        stuffing = max(0, room - len(pes))
        out.append(first + bytes([0x30 | counter, len(clock) + stuffing]) + clock + b"\xff" * stuffing + pes[:room])
        counter = counter + 1 & 15
        i = room
        while i + 184 <= len(pes):
            out += full[counter], pes[i : i + 184]
            counter = counter + 1 & 15
            i += 184
        if i < len(pes):
            stuffing = 183 - (len(pes) - i)
            out.append(later + bytes([0x30 | counter, stuffing]) + (b"\x00" + b"\xff" * (stuffing - 1) if stuffing else b"") + pes[i:])
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """What demux_bytes() finds. units: start packet, pid, time stamp in 90 kHz ticks (-1: none), random access, bytes."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    types: dict[int, int] = field(default_factory=dict)
    counter_errors: int = 0
    bad_packets: int = 0
    bad_tables: int = 0
    units: list[tuple[int, int, int, bool, int]] = field(default_factory=list)
    payload: bytes = b""


@lru_cache(maxsize=1024)
def _parse_section(body: bytes) -> tuple[int, int, bytes] | None:
    """Table id, number and content of a section; None if its check sum is wrong."""
    start = body[0] + 1
    n = int.from_bytes(body[start + 1 : start + 3], "big") & 0x0FFF
    section = body[start : start + 3 + n]
    if len(section) < 12 or crc32_mpeg(section):
        return None
    return section[0], int.from_bytes(section[3:5], "big"), section[8:-4]


def demux_bytes(media: bytes) -> Stream:
    """Parse a transport stream. Packets without sync byte, sections with a wrong check sum and breaks of a continuity counter are counted."""
    out, counters, open_units, parts = Stream(packets=len(media) // PACKET), {}, {}, {}
    done: list[tuple[int, bytes]] = []

    def close(pid: int) -> None:
        unit = open_units.pop(pid, None)
        if unit is None:
            return
        data = b"".join(parts.pop(pid))
        if data[:3] != b"\x00\x00\x01":
            out.bad_packets += 1
            return
        n, head = int.from_bytes(data[4:6], "big"), 9 + data[8]
        body = data[head : 6 + n] if n else data[head:]
        pts = -1
        if data[7] & 0x80:
            p = data[9:14]
            pts = (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1
        out.units.append((unit[0], pid, pts, unit[1], len(body)))
        done.append((unit[0], body))

    for k in range(out.packets):
        at = k * PACKET
        if media[at] != SYNC:
            out.bad_packets += 1
            continue
        pid, control = (media[at + 1] & 0x1F) << 8 | media[at + 2], media[at + 3]
        begins, random, body = media[at + 1] & 0x40, False, at + 4
        if control & 0x20:
            n = media[body]
            random = n > 0 and bool(media[body + 1] & 0x40)
            body += 1 + n
        if not control & 0x10:
            continue
        if pid in counters and counters[pid] + 1 & 15 != control & 15:
            out.counter_errors += 1
        counters[pid] = control & 15
        if pid in out.types:
            if begins:
                close(pid)
                open_units[pid], parts[pid] = (k, random), []
            if pid in parts:
                parts[pid].append(media[body : at + PACKET])
        elif begins and (pid == PAT_PID or pid in out.programs.values()):
            found = _parse_section(media[body : at + PACKET])
            if found is None:
                out.bad_tables += 1
            elif found[0] == 0x00:
                for i in range(0, len(found[2]), 4):
                    out.programs[int.from_bytes(found[2][i : i + 2], "big")] = int.from_bytes(found[2][i + 2 : i + 4], "big") & 0x1FFF
            elif found[0] == 0x02:
                i = 4 + (int.from_bytes(found[2][2:4], "big") & 0x0FFF)
                while i + 5 <= len(found[2]):
                    out.types[int.from_bytes(found[2][i + 1 : i + 3], "big") & 0x1FFF] = found[2][i]
                    i += 5 + (int.from_bytes(found[2][i + 3 : i + 5], "big") & 0x0FFF)
    for pid in list(open_units):
        close(pid)
    done.sort(key=lambda x: x[0])
    out.units.sort()
    out.payload = b"".join(b for _, b in done)
    return out


def padded(data: bytes, to: int = 64) -> bytes:
    """Bytes 0 behind, up to a positive multiple of `to`."""
    return data.ljust(max(1, -(-len(data) // to)) * to, b"\0")


def mux(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as UTF-8, padded, in a transport stream. Null texts count as empty; equal texts give equal streams."""

    def run(batches):
        for b in batches:
            raw = [t.as_py().encode() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, raw), type=pa.int64()), pa.array([mux_bytes(padded(x)) for x in raw], type=pa.binary())], names=["doc_id", "n_bytes", "media"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def demux(media: DataFrame) -> DataFrame:
    """doc_id, payload, packets, counter_errors, bad_packets, units (array of start packet, pid, pts, random access, bytes) of each stream in `media`; null: none."""

    def run(batches):
        unit = pa.struct([("packet", pa.int64()), ("pid", pa.int32()), ("pts", pa.int64()), ("random_access", pa.bool_()), ("bytes", pa.int64())])
        for b in batches:
            found = [demux_bytes(x or b"") for x in b.column("media").to_pylist()]
            names = ["packet", "pid", "pts", "random_access", "bytes"]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([x.payload for x in found], type=pa.binary()), *(pa.array([getattr(x, k) for x in found], type=pa.int64()) for k in ("packets", "counter_errors", "bad_packets")), pa.array([[dict(zip(names, u, strict=True)) for u in x.units] for x in found], type=pa.list_(unit))],
                names=["doc_id", "payload", "packets", "counter_errors", "bad_packets", "units"],
            )

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, payload binary, packets long, counter_errors long, bad_packets long, units array<struct<packet:long,pid:int,pts:long,random_access:boolean,bytes:long>>")


def feature(s: Stream) -> str:
    stamps = [u[2] for u in s.units]
    return (
        f"programs={','.join(f'{p}@{q}' for p, q in sorted(s.programs.items()))};streams={','.join(f'{p}:{t}' for p, t in sorted(s.types.items()))};packets={s.packets};units={len(s.units)}"
        f";counter_errors={s.counter_errors};bad={s.bad_packets + s.bad_tables};pts={min(stamps, default=-1)}-{max(stamps, default=-1)};random_access={sum(u[3] for u in s.units)};largest={max((u[4] for u in s.units), default=0)}"
    )


def digests(media: DataFrame) -> DataFrame:
    """One row of digests and features for each stream that mux() made, from the bytes as they are read back."""

    def run(batches):
        sha = hashlib.sha256
        for b in batches:
            rows = []
            for x in b.column("media"):
                raw = x.as_py()
                s = demux_bytes(raw)
                rows.append((len(s.payload), sha(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(raw), sha(raw).hexdigest(), feature(s)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(stored(mux(table(spark, sf_dir, "documents")), "media"))
