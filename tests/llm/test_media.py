import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import media
from geoloom.llm.common import materialize


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=12_000))
def test_round_trip(raw):
    payload = media.pad(raw)
    stream = media.mux(payload)
    s = media.demux(stream)
    assert s.data[media.ES_PID] == payload and payload.startswith(raw) and len(payload) % 576 == 0 and payload
    assert (s.gaps, s.repeats, s.damaged) == (0, 0, 0) and s.programs == {1: media.PMT_PID}
    assert [o for o, _ in s.stamps[media.ES_PID]] == list(range(0, len(payload), media.ACCESS_UNIT))
    assert len(s.points) == len(s.clocks) == -(-len(s.stamps[media.ES_PID]) // media.GROUP)


def test_time_stamps_keep_33_bits():
    for t in (0, 1, 90_000, (1 << 33) - 1, 0x155555555):
        b = media.stamp(2, t)
        assert (b[0] & 14) << 29 | (b[1] << 8 | b[2]) >> 1 << 15 | (b[3] << 8 | b[4]) >> 1 == t and b[0] >> 4 == 2


def test_the_checksum_is_the_formats():
    assert media.crc(b"123456789") == 0x0376E6E7


def test_damage_is_counted():
    stream = bytearray(media.mux(media.pad(bytes(30_000))))
    lost = bytes(stream[: 188 * 20] + stream[188 * 21 :])
    assert media.demux(lost).gaps == 1 and media.demux(lost).damaged == 1
    twice = bytes(stream[: 188 * 21] + stream[188 * 20 :])
    assert media.demux(twice).repeats == 1 and media.demux(twice).data == media.demux(bytes(stream)).data
    stream[188 * 5] = 0
    assert media.demux(bytes(stream)).damaged >= 1
    stream = bytearray(media.mux(media.pad(b"x")))
    stream[10] ^= 1
    assert media.demux(bytes(stream)).programs == {} and media.demux(bytes(stream)).damaged == 1
    assert media.demux(b"").packets == 0


def bits(packet):
    return "".join(f"{b:08b}" for b in packet)


def remainder(data):
    """The tables' checksum, bit by bit, as a division of polynomials."""
    r = 0xFFFFFFFF
    for bit in "".join(f"{b:08b}" for b in data):
        r = (r << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if (r >> 31) ^ int(bit) else 0)
    return r


def read_apart(stream):
    """A reader of its own, for whole streams of one program: (payload, feature, time stamps, offsets, access packets)."""
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    number = lambda p, a, b: int(bits(p)[a:b], 2)
    by_pid = {}
    for k, p in enumerate(packets):
        assert p[0] == 0x47
        by_pid.setdefault(number(p, 11, 24), []).append((k, p))
    pat = by_pid[0][0][1][5:21]
    pmt_pid = number(pat[10:12], 3, 16)
    pmt = by_pid[pmt_pid][0][1][5:26]
    assert not remainder(pat) and not remainder(pmt)
    kind, pid = pmt[12], number(pmt[13:15], 3, 16)
    units, access, clocks, jumps = [], [], 0, 0
    for group in by_pid.values():
        counts = [p[3] % 16 for _, p in group]
        jumps += sum((b - a) % 16 != 1 for a, b in zip(counts, counts[1:], strict=False))
    for k, p in by_pid[pid]:
        extra = p[4] + 1 if p[3] & 32 else 0
        if extra > 1:
            access += [k] * (p[5] >> 6 & 1)
            clocks += p[5] >> 4 & 1
        units += [b""] * (p[1] >> 6 & 1)
        units[-1] += p[4 + extra :]
    stamps = []
    for u in units:
        t = bits(u[9:14])
        stamps.append(int(t[4:7] + t[8:23] + t[24:39], 2))
        assert u[:4] == b"\0\0\1\xbd" and int.from_bytes(u[4:6], "big") == len(u) - 6
    data = [u[9 + u[8] :] for u in units]
    offsets = [sum(map(len, data[:k])) for k in range(len(data))]
    feature = f"programs=1;pid={pid};type={kind};packets={len(packets)};units={len(units)};gaps={jumps};repeats=0;damaged=0;first_pts={stamps[0]};last_pts={stamps[-1]};back=0;access={len(access)};clocks={clocks}"
    return b"".join(data), feature, stamps, offsets, access


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 200_000), st.integers(0, 255))
def test_features_by_a_reader_of_its_own(size, byte):
    raw = bytes([byte]) * size
    stream = media.mux(media.pad(raw))
    data, *rest = read_apart(stream)
    got = media.describe(size, stream)
    assert data == media.pad(raw) and got[1:6] == [len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(stream), hashlib.sha256(stream).hexdigest()]
    assert got[6:] == rest


def test_reading_can_begin_at_any_access_point():
    payload = media.pad(bytes(i * 7 & 255 for i in range(300_000)))
    stream = media.mux(payload)
    s = media.demux(stream)
    offsets = dict(enumerate(o for o, _ in s.stamps[media.ES_PID]))
    assert len(s.points) > 5
    for j, (k, _) in enumerate(s.points):
        assert media.demux(stream[188 * (k - 2) :]).data[media.ES_PID] == payload[offsets[j * media.GROUP] :]


def test_tables_over_several_packets():
    many = b"".join((k + 2).to_bytes(2, "big") + (0xE000 | 0x1100 + k).to_bytes(2, "big") for k in range(120))
    pat = media.section(0, 1, media.PROGRAM.to_bytes(2, "big") + (0xE000 | media.PMT_PID).to_bytes(2, "big") + many)
    parts = [b"\0" + pat[:183], pat[183:367], bytes([len(pat) - 367]) + pat[367:] + media.PAT]
    packets = [bytes([0x47, 0x40 * (k != 1), 0, 0x10 | k]) + p.ljust(184, b"\xff") for k, p in enumerate(parts)]
    s = media.demux(b"".join(packets))
    assert (len(s.programs), s.damaged, s.gaps) == (121, 0, 0)
    cut = media.demux(packets[0] + packets[2])
    assert cut.gaps == 1 and cut.damaged == 1 and cut.programs == {1: media.PMT_PID}
    assert media.demux(packets[0]).damaged == 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 188 * 40 - 1), st.integers(0, 255)), max_size=30), st.integers(0, 188 * 40), st.binary(max_size=400))
def test_no_damage_is_raised(changes, cut, tail):
    stream = bytearray(media.mux(media.pad(bytes(6_000)))[: 188 * 40])
    for at, value in changes:
        stream[at % len(stream)] = value
    s = media.demux(bytes(stream[:cut]) + tail)
    assert s.damaged >= 0 and len(media.describe(0, bytes(stream))) == 10


def test_wrong_fields_are_damage():
    packet = lambda start, pid, control, body: bytes([0x47, start | pid >> 8, pid & 255, control]) + body.ljust(184, b"\xff")
    assert media.demux(packet(0x40, 0, 0x30, bytes([183]) + bytes(183))).damaged == 1  # no room is left for the table
    assert media.demux(packet(0x40, 0, 0x30, bytes([184]))).damaged == 1
    assert media.demux(packet(0x40, 0x100, 0x20, bytes([1, 0x10]))).damaged == 1  # a clock that the field has no room for
    pes = media.TABLES[0] + bytes([0x47, 0x41, 0, 0x30, 173]) + bytes(173) + b"\0\0\1\xbd\0\4\x84\x80\1\0"
    s = media.demux(pes)
    assert s.damaged == 1 and not s.stamps and s.data == {media.ES_PID: b""}


def test_null_media(spark):
    row = media.media_features(spark.createDataFrame([(None, None, None)], "doc_id long, n_bytes long, media binary")).first()
    assert row["payload_bytes"] == 0 and row["pts"] == [] and "packets=0" in row["feature"]


def test_stored_and_read_back(edge, sample, nothing):
    for docs in (edge, sample):
        stored = materialize(media.store_media(docs), "media", "zstd")
        got = media.media_features(stored).collect()
        want = []
        for r in docs.collect():
            raw = (r["text"] or "").encode()
            payload = media.pad(raw)
            want.append((r["doc_id"], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media.mux(payload)), hashlib.sha256(media.mux(payload)).hexdigest()))
        keys = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
        assert sorted((tuple(r[k] for k in keys) for r in got), key=str) == sorted(want, key=str)
        assert all("damaged=0" in r["feature"] and "gaps=0" in r["feature"] for r in got)
        assert all(r["pts"] == [media.FIRST_PTS + k * media.TICKS for k in range(len(r["pts"]))] and len(r["pts"]) == len(r["pts_offsets"]) and len(r["access_packets"]) == -(-len(r["pts"]) // media.GROUP) for r in got)
    assert media.media_features(media.store_media(nothing)).isEmpty()


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577])
def test_padding(n):
    assert len(media.pad(bytes(n))) == 576 * max(1, -(-n // 576))
