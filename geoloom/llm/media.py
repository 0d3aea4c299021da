"""Media columns: payloads stored as MPEG transport streams, and the features that reading them back gives.

A stream holds one program: PAT on PID 0, PMT on PID PMT_PID, and one private elementary stream on ES_PID. Each access unit
of the payload is one PES packet with a time stamp; packets that begin a group of units carry a random-access point and a
clock reference, and follow a PAT and a PMT, so that reading can begin there. Reading trusts nothing that writing knew: program
tables are put together, checked and followed, continuity is counted for each PID, and elementary packets are put together from
their parts. Time stamps and random-access points are kept beside the features.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import documents, groups, map_arrow, materialize

# Fixed values of the transport stream format.
PACKET, SYNC = 188, 0x47
PAT_PID, NULL_PID = 0, 0x1FFF
PMT_PID, ES_PID, PROGRAM = 0x1000, 0x100, 1
PRIVATE_PES = 0x06  # stream type: private data in PES packets
STREAM_ID = 0xBD  # private stream 1
CLOCK = 90_000  # ticks of time stamps in a second

#: Bytes that payloads are padded to a multiple of, bytes of an access unit, ticks between units, units between random-access points.
UNIT = 576
ACCESS_UNIT = 8 * UNIT
TICKS = CLOCK // 25
GROUP = 8
FIRST_PTS = CLOCK


def crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


CRC = crc_table()


def crc(data: bytes) -> int:
    """The checksum of program tables; over a table with its own checksum it is 0."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC[c >> 24 ^ b]
    return c


def section(table: int, key: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + key.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc(head + body).to_bytes(4, "big")


def table_packet(pid: int, data: bytes, count: int = 0) -> bytes:
    return bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | count, 0]) + data.ljust(PACKET - 5, b"\xff")


PAT = section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_PES]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0")
#: The packets of both tables, for each value of their continuity counter.
TABLES = [table_packet(PAT_PID, PAT, k) + table_packet(PMT_PID, PMT, k) for k in range(16)]


def stamp(mark: int, t: int) -> bytes:
    """A time stamp of 33 bits as PES headers hold it."""
    return bytes([mark << 4 | t >> 29 & 14 | 1]) + ((t >> 14 & 0xFFFE) | 1).to_bytes(2, "big") + ((t << 1 & 0xFFFE) | 1).to_bytes(2, "big")


def pad(raw: bytes) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\xff")


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, count = [], 0
    for k, at in enumerate(range(0, len(payload), ACCESS_UNIT)):
        unit, pts = payload[at : at + ACCESS_UNIT], (FIRST_PTS + k * TICKS) & (1 << 33) - 1
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(2, pts) + unit
        if k % GROUP:
            field_ = b""
        else:
            out.append(TABLES[k // GROUP & 15])
            base = pts - TICKS & (1 << 33) - 1  # the clock runs one unit ahead of its first time stamp
            field_ = b"\x50" + (base << 15 | 0x7E00).to_bytes(6, "big")
        pos, start = 0, 0x40
        while pos < len(pes):
            room = PACKET - 4 - (len(field_) + 1 if field_ else 0)
            part = pes[pos : pos + room]
            if len(part) < room or field_:
                length = PACKET - 5 - len(part)
                extra = bytes([length]) + ((field_ or b"\0").ljust(length, b"\xff") if length else b"")
                control = 0x30
            else:
                extra, control = b"", 0x10
            out.append(bytes([SYNC, start | ES_PID >> 8, ES_PID & 255, control | count]) + extra + part)
            count, pos, start, field_ = count + 1 & 15, pos + len(part), 0, b""
    return b"".join(out)


@dataclass
class Stream:
    """What reading a transport stream gives."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # program: PID of its map
    kinds: dict[int, int] = field(default_factory=dict)  # PID: stream type
    gaps: int = 0  # breaks of continuity
    repeats: int = 0
    damaged: int = 0  # packets without sync or with a wrong field, tables that are cut or have a wrong checksum, elementary packets of a wrong length
    data: dict[int, bytes] = field(default_factory=dict)  # PID: payload
    stamps: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # PID: (byte offset in data, time stamp)
    points: list[tuple[int, int]] = field(default_factory=list)  # (packet number, PID) of random-access points
    clocks: list[int] = field(default_factory=list)


def demux(media: bytes) -> Stream:
    """Read a transport stream whole. Whatever the bytes are, damage is counted, not raised; what can be put together is."""
    s = Stream(packets=len(media) // PACKET, damaged=int(len(media) % PACKET > 0))
    counters: dict[int, int] = {}
    parts: dict[int, list[bytes]] = {}
    open_tables: dict[int, bytes] = {}
    done: dict[int, list[bytes]] = defaultdict(list)
    sizes: dict[int, int] = defaultdict(int)

    def end(pid: int) -> None:
        pes = b"".join(parts.pop(pid, ()))
        if not pes:
            return
        if pes[:3] != b"\0\0\1" or len(pes) < 9 or 9 + pes[8] > len(pes):
            s.damaged += 1
            return
        stated, head = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
        if stated and stated + 6 != len(pes):
            s.damaged += 1
        if pes[7] & 0x80:
            if head < 14:
                s.damaged += 1
            else:
                t = pes[9:14]
                pts = (t[0] & 14) << 29 | (t[1] << 8 | t[2]) >> 1 << 15 | (t[3] << 8 | t[4]) >> 1
                s.stamps.setdefault(pid, []).append((sizes[pid], pts))
        body = pes[head : stated + 6 if stated else None]
        done[pid].append(body)
        sizes[pid] += len(body)

    for k in range(s.packets):
        at = k * PACKET
        if media[at] != SYNC or media[at + 1] & 0x80:
            s.damaged += 1
            continue
        b1, b3 = media[at + 1], media[at + 3]
        pid = (b1 & 31) << 8 | media[at + 2]
        if pid == NULL_PID:
            continue
        body = at + 4
        broken = False
        if b3 & 0x20:
            length = media[body]
            flags = media[body + 1] if length else 0
            if length > PACKET - 5 or (flags & 0x10 and length < 7):
                s.damaged += 1
                continue
            broken = bool(flags & 0x80)
            if flags & 0x40:
                s.points.append((k, pid))
            if flags & 0x10:
                s.clocks.append(int.from_bytes(media[body + 2 : body + 8], "big") >> 15)
            body += 1 + length
        if not b3 & 0x10:
            continue
        n, before = b3 & 15, counters.get(pid)
        counters[pid] = n
        if before is not None and not broken:
            if n == before:
                s.repeats += 1
                continue
            if n != before + 1 & 15:
                s.gaps += 1
                if open_tables.pop(pid, b""):
                    s.damaged += 1
        chunk = media[body : at + PACKET]
        if pid == PAT_PID or pid in s.programs.values():
            sections(s, open_tables, pid, chunk, bool(b1 & 0x40))
        elif pid in s.kinds:
            if b1 & 0x40:
                end(pid)
                parts[pid] = [chunk]
            elif pid in parts:
                parts[pid].append(chunk)
    for pid in list(parts):
        end(pid)
    s.damaged += sum(map(bool, open_tables.values()))
    s.data = {pid: b"".join(x) for pid, x in done.items()}
    return s


def sections(s: Stream, open_tables: dict[int, bytes], pid: int, chunk: bytes, start: bool) -> None:
    """Take one packet's part of the tables of a PID; open_tables holds what has come of a table that isn't complete. A packet in
    which a table starts says at its head how many bytes end the one before; stuffing ends the last."""
    if start:
        if not chunk or 1 + chunk[0] > len(chunk):
            s.damaged += 1
            open_tables.pop(pid, None)
            return
        cut = 1 + chunk[0]
        if open_tables.get(pid) and _complete(s, pid, open_tables.pop(pid) + chunk[1:cut]):
            s.damaged += 1
        open_tables[pid] = _complete(s, pid, chunk[cut:])
    elif open_tables.get(pid):
        open_tables[pid] = _complete(s, pid, open_tables[pid] + chunk)


def _complete(s: Stream, pid: int, data: bytes) -> bytes:
    """What is left of data after its complete tables are taken; nothing if that is stuffing."""
    while data and data[0] != 0xFF:
        if len(data) < 3 or len(data) < (size := 3 + ((data[1] & 15) << 8 | data[2])):
            return data
        table(s, pid, data[:size])
        data = data[size:]
    return b""


def table(s: Stream, pid: int, data: bytes) -> None:
    """Take the programs or the streams from a whole table."""
    size, program_map = len(data), len(data) > 0 and data[0] == 2
    if size < (16 if program_map else 12) or crc(data):
        s.damaged += 1
    elif pid == PAT_PID and data[0] == 0:
        for i in range(8, size - 4, 4):
            if number := data[i] << 8 | data[i + 1]:
                s.programs[number] = (data[i + 2] & 31) << 8 | data[i + 3]
    elif program_map:
        i = 12 + ((data[10] & 15) << 8 | data[11])
        while i + 5 <= size - 4:
            s.kinds[(data[i + 1] & 31) << 8 | data[i + 2]] = data[i]
            i += 5 + ((data[i + 3] & 15) << 8 | data[i + 4])


MEDIA = "n_bytes long, media binary"
FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<bigint>, pts_offsets array<bigint>, access_packets array<bigint>"


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media: each whole text as the transport stream of its padded UTF-8 bytes.

    Null and empty texts give one unit of padding. Null ids and repeated rows stay, one row out for each row in; an empty
    table gives an empty result; other columns are not read. The result is to be written: media is the stored form.
    """
    picked = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            for at, n in groups(batch.column(1)):
                part = batch.slice(at, n)
                raws = [t.encode() for t in part.column(1).to_pylist()]
                arrays = [part.column(0), pa.array(list(map(len, raws)), pa.int64()), pa.array([mux(pad(r)) for r in raws], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_bytes", "media"])

    return map_arrow(picked, run, f"{picked.select(id_col).schema[0].simpleString().replace(':', ' ', 1)}, {MEDIA}")


def describe(n_bytes: int, media: bytes) -> list:
    """The features of one stored stream, from its bytes alone (but for n_bytes, which is handed on)."""
    s = demux(media)
    pid = min(s.kinds, default=NULL_PID)
    data, stamps = s.data.get(pid, b""), s.stamps.get(pid, [])
    times = [t for _, t in stamps]
    steps = np.diff(times)
    feature = (
        f"programs={len(s.programs)};pid={pid};type={s.kinds.get(pid, 0)};packets={s.packets};units={len(stamps)};gaps={s.gaps};repeats={s.repeats};damaged={s.damaged};"
        f"first_pts={times[0] if times else -1};last_pts={times[-1] if times else -1};back={int((steps <= 0).sum())};access={len(s.points)};clocks={len(s.clocks)}"
    )
    return [n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, times, [o for o, _ in stamps], [k for k, p in s.points if p == pid]]


def media_features(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each stored stream: what FEATURES names.

    The payload is put together from elementary packets after following PAT and PMT. pts and pts_offsets: time stamps and
    the byte of the payload where each begins; access_packets: packet numbers of random-access points. Null media give a
    stream without packets, and so empty features.
    """
    picked = stored.select(id_col, "n_bytes", "media")

    def run(batches):
        for batch in batches:
            sizes = batch.column(1).to_pylist()
            for at in range(0, len(sizes), 64):
                found = [describe(n, m or b"") for n, m in zip(sizes[at : at + 64], batch.column(2).slice(at, 64).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 64), *(pa.array(x, k) for x, k in zip(zip(*found, strict=True), KINDS, strict=True))], names=[id_col, *NAMES])

    return map_arrow(picked, run, f"{picked.select(id_col).schema[0].simpleString().replace(':', ' ', 1)}, {FEATURES}")


NAMES = [x.split()[0] for x in FEATURES.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(materialize(store_media(documents(spark, sf_dir)), "media", codec="zstd"))


QUERIES = {"op10_media": op10_media}
