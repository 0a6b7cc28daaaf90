import random
import struct

import numpy as np
import pytest

from tidemark.functions import codec, crc
from tidemark.functions.codec import CodecError, Record


def plain_crc(data):
    r = 0xFFFFFFFF
    for b in data:
        r ^= b
        for _ in range(8):
            r = r >> 1 ^ (0x82F63B78 if r & 1 else 0)
    return r ^ 0xFFFFFFFF


def test_crc_vector_and_lengths():
    assert crc.crc32c(b"123456789") == 0xE3069283
    r = random.Random(0)
    values = [r.randbytes(n) for n in (0, 1, 7, 1023, 1024, 1025, 2048, 5000)]
    assert crc.crc32c_many(values).tolist() == [plain_crc(v) for v in values]
    assert crc.crc32c_many([]).tolist() == []


def records(n, size=20):
    return [Record(i, 1000 + i, i % 7, b"h" * (i % 3), random.Random(i).randbytes(size)) for i in range(n)]


def test_record_golden_bytes():
    frame = codec.encode_records([Record(5, 9, 1, b"ab", b"xyz")])[0]
    body = bytes.fromhex("0001 0001 0000 00000002 00000003 0000000000000009 0000000000000005") + b"abxyz"
    assert frame == b"\x4b\x52" + body + struct.pack(">I", plain_crc(body))
    assert codec.decode_record(frame) == (Record(5, 9, 1, b"ab", b"xyz"), len(frame))
    assert len(frame) == codec.bytes_len(b"ab", b"xyz")


def test_record_errors_in_order():
    frame = codec.encode_records([Record(5, 9, 1, b"ab", b"xyz")])[0]
    for broken, reason in ((frame[:31], "Truncated"), (b"xx" + frame[2:], "BadMagic"), (frame[:3] + b"\x02" + frame[4:], "BadVersion"), (frame[:-1], "Truncated"), (frame[:-1] + b"\0", "CrcMismatch"), (frame[:16] + b"\xff" * 8 + frame[24:], "OutOfRange")):
        with pytest.raises(CodecError) as e:
            codec.decode_record(broken)
        assert e.value.reason == reason


def test_scan_torn_tail_beyond_the_first_chunk():
    frames = codec.encode_records(records(1000, 32))
    buf = b"".join(frames)[:-17]
    assert [r.offset for _, r in codec.scan(buf, 0, "stop")] == list(range(999))
    with pytest.raises(CodecError):
        list(codec.scan(buf, 0, "fail"))


def test_scan_corruption_in_the_middle():
    frames = codec.encode_records(records(200))
    buf = bytearray(b"".join(frames))
    at = sum(map(len, frames[:50])) + 40
    buf[at] ^= 0xFF
    assert [r.offset for _, r in codec.scan(bytes(buf), 0, "resync")] == [i for i in range(200) if i != 50]
    assert [r.offset for _, r in codec.scan(bytes(buf), 0, "stop", batch=7)] == list(range(50))
    assert len(list(codec.scan(bytes(buf), 0, "resync", verify=False))) == 200


def test_events_round_trip_and_errors():
    cases = [("Enqueue", {"off": 3, "retries": 2}), ("MarkInflight", {"off": 3, "deadline": 99}), ("Ack", {"off": 1}), ("Nack", {"off": 1, "requeue": True}), ("Nack", {"off": 1, "requeue": False}), ("DeadLetter", {"off": 1}), ("ClearInflight", {"off": 1}), ("ResetQueue", {}), ("Snapshot", {"blob": b"xy"})]
    for kind, values in cases:
        raw = codec.encode_event(kind, "tøpic", 7, **values)
        row = codec.decode_event(raw + b"trailing")
        assert row == {**dict.fromkeys(("off", "retries", "deadline", "requeue", "blob")), "topic": "tøpic", "part": 7, "event_type": kind, **values}
        for cut in range(len(raw)):
            with pytest.raises(CodecError):
                codec.decode_event(raw[:cut])
    raw = codec.encode_event("Ack", "t", 0, off=1)
    for broken, reason in ((b"X" + raw[1:], "BadMagic"), (raw[:9] + b"\x09" + raw[10:], "BadVersion"), (raw[:11] + b"\x63" + raw[12:], "UnknownType"), (raw[:14] + b"\xff" + raw[15:], "BadUtf8"), (raw[:-8] + b"\xff" * 8, "OutOfRange")):
        with pytest.raises(CodecError) as e:
            codec.decode_event(broken)
        assert e.value.reason == reason
    with pytest.raises(CodecError):
        codec.encode_event("Ack", "t" * 70_000, 0, off=1)


def test_snapshots_and_manifests():
    blob = codec.encode_state(10, [3, 12, 15, 9_999_999], {11: 70, 12: 71}, {11: 1, 5: 2})
    assert codec.decode_state(blob) == (10, [12, 15], {11: 70}, {11: 1})
    raw = codec.encode_snapshot(42, blob)
    assert codec.decode_snapshot(raw) == (42, blob)
    for broken in (raw[:20], b"x" + raw[1:], raw[:-1] + b"\0", raw[:9] + b"\2" + raw[10:]):
        with pytest.raises(CodecError):
            codec.decode_snapshot(broken)
    m = codec.encode_manifest(123, 4096, 128, 7, 9, 3)
    assert codec.decode_manifest(m) == {"created_ms": 123, "segment_max": 4096, "stride": 128, "active_base": 7, "next_offset": 9, "head_offset": 3}
    with pytest.raises(CodecError):
        codec.decode_manifest(m[:-1] + b"\1")
    assert len(codec.segment_head(1, 2)) == 68 and codec.check_segment(codec.segment_head(1, 2)) == 1 and len(codec.index_head(1, 2)) == 72
    assert codec.read_index(codec.index_head(5, 0) + codec.index_entry(5, 9, 777) + b"torn") == [(4, 777)]


def test_random_bytes_never_crash():
    r = np.random.default_rng(1)
    for n in (0, 1, 40, 5000):
        data = r.integers(0, 256, n, dtype=np.uint8).tobytes()
        assert list(codec.scan(data, 0)) == []
