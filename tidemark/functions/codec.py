"""Byte formats: records, segment and index headers, manifests, queue events, snapshots.

Encoding and decoding work on lists, so checksums are made for a whole batch at once.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from tidemark.functions.crc import crc32c, crc32c_many, crc32c_spans

# Fixed values of the formats; the file marks are the engine's own.
RECORD_MAGIC = 0x4B52
RECORD_HEAD = struct.Struct(">HHHHIIQQ")
FRAME_HEAD = struct.Struct(">HH4xIIQQ")
RECORD_OVERHEAD = RECORD_HEAD.size + 4
SEGMENT_MAGIC, INDEX_MAGIC = b"TIDESEG\0", b"TIDEIDX\0"
SEGMENT_HEAD, INDEX_HEAD = 68, 72
MANIFEST_MAGIC = b"TIDEMAN\0"
EVENT_MAGIC = b"TIDEEVT\0"
SNAPSHOT_MAGIC = b"TIDESNP\0"
EVENT_CODES = {
    "Enqueue": 0,
    "MarkInflight": 1,
    "Ack": 10,
    "Nack": 11,
    "DeadLetter": 12,
    "ClearInflight": 20,
    "ResetQueue": 30,
    "Snapshot": 60,
}
VERSION = 1
EVENT_NAMES = {v: k for k, v in EVENT_CODES.items()}
BIGGEST = (1 << 63) - 1


class CodecError(ValueError):
    """A byte string that isn't what it should be; ``reason`` is one word."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


@dataclass
class Record:
    offset: int
    timestamp_ms: int
    flags: int
    headers: bytes
    payload: bytes


def encode_records(records: list[Record]) -> list[bytes]:
    bodies = []
    for r in records:
        h, p = r.headers or b"", r.payload or b""
        if len(h) >= 1 << 32 or len(p) >= 1 << 32:
            raise CodecError("LengthOverflow")
        if not (0 <= r.offset <= BIGGEST and 0 <= r.timestamp_ms <= BIGGEST):
            raise CodecError("OutOfRange")
        bodies.append(RECORD_HEAD.pack(RECORD_MAGIC, VERSION, r.flags, 0, len(h), len(p), r.timestamp_ms, r.offset) + h + p)
    sums = crc32c_many([b[2:] for b in bodies])
    return [b + struct.pack(">I", s) for b, s in zip(bodies, sums.tolist(), strict=True)]


def bytes_len(headers: bytes | None, payload: bytes | None) -> int:
    return RECORD_OVERHEAD + len(headers or b"") + len(payload or b"")


def frame_error(buf, at: int) -> tuple[str | None, int]:
    """(reason, size): what is wrong with the frame at ``at`` before its checksum, or its whole size."""
    left = len(buf) - at
    if left < RECORD_HEAD.size:
        return "Truncated", 0
    magic, version, _, _, h, p, ts, off = RECORD_HEAD.unpack_from(buf, at)
    if magic != RECORD_MAGIC:
        return "BadMagic", 0
    if version != VERSION:
        return "BadVersion", 0
    size = RECORD_OVERHEAD + h + p
    if ts > BIGGEST or off > BIGGEST:
        return "OutOfRange", size
    return ("Truncated", size) if left < size else (None, size)


def decode_record(buf: bytes, at: int = 0) -> tuple[Record, int]:
    """The record at ``at`` and its size; raises CodecError."""
    reason, size = frame_error(buf, at)
    if reason:
        raise CodecError(reason)
    if crc32c(bytes(buf[at + 2 : at + size - 4])) != struct.unpack_from(">I", buf, at + size - 4)[0]:
        raise CodecError("CrcMismatch")
    return unpack(buf, at, size), size


def decode_header(buf: bytes, at: int = 0) -> tuple[dict, int]:
    """The fields of the record head at ``at``, and how many bytes of its body are missing (below zero: bytes that follow it)."""
    reason, size = frame_error(buf, at)
    if reason and not size:
        raise CodecError(reason)
    names = ("magic", "version", "flags", "reserved", "headers_len", "payload_len", "timestamp_ms", "offset")
    return dict(zip(names, RECORD_HEAD.unpack_from(buf, at), strict=True)), size - (len(buf) - at)


def unpack(buf, at: int, size: int, payload: bool = True) -> Record:
    _, _, flags, _, h, _, ts, off = RECORD_HEAD.unpack_from(buf, at)
    mid = at + RECORD_HEAD.size + h
    return Record(off, ts, flags, bytes(buf[mid - h : mid]), bytes(buf[mid : at + size - 4]) if payload else b"")


def frames(buf: bytes, at: int, corruption: str = "resync", verify: bool = True, batch: int = 4096):
    """(positions, sizes) of each batch of good frames from ``at``, as arrays; returns why it ended, or None at the end of ``buf``.

    ``corruption`` says what happens at a bad one: 'stop' ends there, 'fail' raises, 'resync' tries
    again from the next byte. A torn tail ends the scan in any case but 'fail'.
    """
    data, unpack_from, whole = np.frombuffer(buf, np.uint8), FRAME_HEAD.unpack_from, len(buf)
    while at < whole:
        places, end, reason = [], at, None
        while end < whole and len(places) < batch:
            if end + RECORD_HEAD.size <= whole:
                magic, version, h, p, ts, off = unpack_from(buf, end)
                nxt = end + RECORD_OVERHEAD + h + p
                if magic == RECORD_MAGIC and version == VERSION and nxt <= whole and ts <= BIGGEST and off <= BIGGEST:
                    places.append(end)
                    end = nxt
                    continue
            reason = frame_error(buf, end)[0]
            break
        starts = np.array(places, np.int64)
        sizes = np.diff(np.append(starts, end))
        if verify and len(starts):
            want = data[(starts + sizes)[:, None] + np.arange(-4, 0)].view(">u4")[:, 0]
            bad = np.flatnonzero(crc32c_spans(data, starts + 2, sizes - 6) != want)
            if len(bad):
                starts, sizes, end, reason = starts[: bad[0]], sizes[: bad[0]], places[bad[0]], "CrcMismatch"
        if len(starts):
            yield starts, sizes
        at = end
        if reason:
            if corruption == "fail":
                raise CodecError(reason)
            if corruption == "stop":
                return reason
            nxt = buf.find(struct.pack(">H", RECORD_MAGIC), at + 1)
            if nxt < 0:
                return reason
            at = nxt
    return None


def scan(buf: bytes, at: int, corruption: str = "resync", verify: bool = True, payload: bool = True, batch: int = 4096):
    """(position, record) for each good record from ``at``; see frames()."""
    for starts, sizes in frames(buf, at, corruption, verify, batch):
        for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            yield a, unpack(buf, a, n, payload)


def columns(buf: bytes, starts: np.ndarray, sizes: np.ndarray, payload: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, list | None]:
    """(offsets, timestamps, flags, headers, payloads) of good frames, as arrays and lists."""
    heads = np.frombuffer(buf, np.uint8)[starts[:, None] + np.arange(RECORD_HEAD.size)]
    field = lambda a, b, kind: np.ascontiguousarray(heads[:, a:b]).view(kind)[:, 0]
    body = starts + RECORD_HEAD.size
    mid, ends = (body + field(8, 12, ">u4")).tolist(), (starts + sizes - 4).tolist()
    headers = [buf[a:b] for a, b in zip(body.tolist(), mid, strict=True)]
    payloads = [buf[a:b] for a, b in zip(mid, ends, strict=True)] if payload else None
    return field(24, 32, ">u8").astype(np.int64), field(16, 24, ">u8").astype(np.int64), field(4, 6, ">u2").astype(np.int32), headers, payloads


def encode_columns(offsets: list, timestamps: list, flags: list, headers: list, payloads: list) -> tuple[bytearray, np.ndarray]:
    """The frames of records one after the other, and where each ends."""
    if offsets and not (0 <= min(offsets) and max(offsets) <= BIGGEST and 0 <= min(timestamps) and max(timestamps) <= BIGGEST):
        raise CodecError("OutOfRange")
    if max(map(len, headers), default=0) >= 1 << 32 or max(map(len, payloads), default=0) >= 1 << 32:
        raise CodecError("LengthOverflow")
    pack, none = RECORD_HEAD.pack, bytes(4)
    made = [pack(RECORD_MAGIC, VERSION, f, 0, len(h), len(p), t, o) + h + p + none for o, t, f, h, p in zip(offsets, timestamps, flags, headers, payloads, strict=True)]
    ends = np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))
    buf = bytearray().join(made)
    data = np.frombuffer(buf, np.uint8)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    sums = crc32c_spans(data, starts + 2, ends - starts - 6)
    if len(made):
        data[ends[:, None] + np.arange(-4, 0)] = sums.astype(">u4").view(np.uint8).reshape(-1, 4)
    return buf, ends


def segment_head(base: int, created_ms: int) -> bytes:
    body = SEGMENT_MAGIC + struct.pack(">HHIQQ", VERSION, 0, SEGMENT_HEAD, base, created_ms) + bytes(32)
    return body + struct.pack(">I", crc32c(body))


def index_head(base: int, created_ms: int) -> bytes:
    body = INDEX_MAGIC + struct.pack(">HHIQQHH", VERSION, 0, INDEX_HEAD, base, created_ms, 16, 0) + bytes(32)
    return body + struct.pack(">I", crc32c(body))


def index_entry(base: int, offset: int, position: int) -> bytes:
    return struct.pack(">IIQ", offset - base, 0, position)


class IndexWriter:
    """The index of a segment that is being written; entries must rise."""

    def __init__(self, base: int, created_ms: int):
        self.base, self.last, self.made = base, -1, [index_head(base, created_ms)]

    def add(self, offset: int, position: int) -> None:
        if offset - self.base <= self.last:
            raise CodecError("IndexOrder")
        self.last = offset - self.base
        self.made.append(index_entry(self.base, offset, position))

    def bytes(self) -> bytes:
        return b"".join(self.made)


def read_index(buf: bytes) -> list[tuple[int, int]]:
    """(relative offset, position) of each whole entry; a torn or unknown index has none."""
    if len(buf) < INDEX_HEAD or buf[:8] != INDEX_MAGIC or struct.unpack_from(">H", buf, 8)[0] != VERSION:
        return []
    n = (len(buf) - INDEX_HEAD) // 16
    return [(rel, pos) for rel, _, pos in struct.iter_unpack(">IIQ", buf[INDEX_HEAD : INDEX_HEAD + 16 * n])]


def check_segment(buf: bytes) -> int:
    """The base offset of a segment; raises CodecError."""
    if len(buf) < SEGMENT_HEAD:
        raise CodecError("Truncated")
    if buf[:8] != SEGMENT_MAGIC:
        raise CodecError("BadMagic")
    if struct.unpack_from(">H", buf, 8)[0] != VERSION:
        raise CodecError("BadVersion")
    return struct.unpack_from(">Q", buf, 16)[0]


def encode_manifest(created_ms: int, segment_max: int, stride: int, active_base: int, next_offset: int, head_offset: int) -> bytes:
    body = struct.pack(">QQIIQQQ", created_ms, segment_max, stride, 0, active_base, next_offset, head_offset)
    return MANIFEST_MAGIC + struct.pack(">HHII", VERSION, 0, 20, crc32c(body)) + body


def decode_manifest(buf: bytes) -> dict:
    if len(buf) < 68:
        raise CodecError("Truncated")
    if buf[:8] != MANIFEST_MAGIC:
        raise CodecError("BadMagic")
    version, _, head, crc = struct.unpack_from(">HHII", buf, 8)
    if version != VERSION:
        raise CodecError("BadVersion")
    body = buf[head : head + 48]
    if crc32c(body) != crc:
        raise CodecError("CrcMismatch")
    names = ("created_ms", "segment_max", "stride", "pad", "active_base", "next_offset", "head_offset")
    return {k: v for k, v in zip(names, struct.unpack(">QQIIQQQ", body), strict=True) if k != "pad"}


def encode_event(event_type: str, topic: str, part: int, off: int | None = None, retries: int | None = None, deadline: int | None = None, requeue: bool | None = None, blob: bytes | None = None) -> bytes:
    name = topic.encode()
    if len(name) > 65_535:
        raise CodecError("LengthOverflow")
    head = EVENT_MAGIC + struct.pack(">HHH", VERSION, EVENT_CODES[event_type], len(name)) + name + struct.pack(">I", part)
    if event_type == "Enqueue":
        return head + struct.pack(">QI", off, retries or 0)
    if event_type == "MarkInflight":
        return head + struct.pack(">QQ", off, deadline)
    if event_type == "Nack":
        return head + struct.pack(">QB", off, bool(requeue))
    if event_type == "Snapshot":
        return head + struct.pack(">I", len(blob or b"")) + (blob or b"")
    return head if event_type == "ResetQueue" else head + struct.pack(">Q", off)


def decode_event(buf: bytes) -> dict:
    """A row of queue_events without seq; trailing bytes are ignored; raises CodecError."""
    row = dict.fromkeys(("topic", "part", "event_type", "off", "retries", "deadline", "requeue", "blob"))
    try:
        if buf[:8] != EVENT_MAGIC:
            raise CodecError("BadMagic" if len(buf) >= 8 else "Truncated")
        version, code, n = struct.unpack_from(">HHH", buf, 8)
        if version != VERSION:
            raise CodecError("BadVersion")
        if code not in EVENT_NAMES:
            raise CodecError("UnknownType")
        if len(buf) < 14 + n:
            raise CodecError("Truncated")
        row["topic"], row["event_type"] = buf[14 : 14 + n].decode(), EVENT_NAMES[code]
        at = 14 + n
        row["part"] = struct.unpack_from(">I", buf, at)[0]
        at += 4
        if row["event_type"] == "Snapshot":
            size = struct.unpack_from(">I", buf, at)[0]
            if len(buf) < at + 4 + size:
                raise CodecError("Truncated")
            row["blob"] = bytes(buf[at + 4 : at + 4 + size])
        elif row["event_type"] != "ResetQueue":
            row["off"] = struct.unpack_from(">Q", buf, at)[0]
            at += 8
        if row["event_type"] == "Enqueue":
            row["retries"] = struct.unpack_from(">I", buf, at)[0]
        elif row["event_type"] == "MarkInflight":
            row["deadline"] = struct.unpack_from(">Q", buf, at)[0]
        elif row["event_type"] == "Nack":
            row["requeue"] = struct.unpack_from(">B", buf, at)[0] != 0
    except struct.error:
        raise CodecError("Truncated") from None
    except UnicodeDecodeError:
        raise CodecError("BadUtf8") from None
    if max(row["off"] or 0, row["deadline"] or 0) > BIGGEST:
        raise CodecError("OutOfRange")
    return row


TAILS = {"Enqueue": struct.Struct(">QI"), "MarkInflight": struct.Struct(">QQ"), "Nack": struct.Struct(">QB"), "Ack": struct.Struct(">Q"), "DeadLetter": struct.Struct(">Q"), "ClearInflight": struct.Struct(">Q")}


def encode_events(rows) -> list[bytes]:
    """encode_event of each row; the head of a queue's events of one kind is made once."""
    heads, out = {}, []
    for kind, topic, part, off, retries, deadline, requeue, blob in rows:
        tail = TAILS.get(kind)
        if tail is None:
            out.append(encode_event(kind, topic, part, off, retries, deadline, requeue, blob))
            continue
        head = heads.get((kind, topic, part))
        if head is None:
            head = heads[kind, topic, part] = encode_event("ResetQueue", topic, part)[:10] + struct.pack(">H", EVENT_CODES[kind]) + encode_event("ResetQueue", topic, part)[12:]
        if kind == "Enqueue":
            out.append(head + tail.pack(off, retries or 0))
        elif kind == "MarkInflight":
            out.append(head + tail.pack(off, deadline))
        elif kind == "Nack":
            out.append(head + tail.pack(off, bool(requeue)))
        else:
            out.append(head + tail.pack(off))
    return out


def decode_events(values: list[bytes]) -> dict[str, list]:
    """The columns of decode_event for many; the head of a queue's events of one kind is read once."""
    names = ("topic", "part", "event_type", "off", "retries", "deadline", "requeue", "blob")
    out, heads, n = {c: [None] * len(values) for c in names}, {}, 18
    topic, part, kinds, offs, retries, deadlines, requeues, blobs = out.values()
    for i, v in enumerate(values):
        known = heads.get(v[:n])
        if known is None or len(v) < n + known[3].size:
            row = decode_event(v)
            topic[i], part[i], kinds[i], offs[i], retries[i], deadlines[i], requeues[i], blobs[i] = (row[c] for c in names)
            n = 18 + struct.unpack_from(">H", v, 12)[0]
            if row["event_type"] in TAILS:
                heads[v[:n]] = row["topic"], row["part"], row["event_type"], TAILS[row["event_type"]]
            continue
        topic[i], part[i], kind, tail = known
        kinds[i] = kind
        read = tail.unpack_from(v, n)
        offs[i] = read[0]
        if kind == "Enqueue":
            retries[i] = read[1]
        elif kind == "MarkInflight":
            deadlines[i] = read[1]
        elif kind == "Nack":
            requeues[i] = read[1] != 0
        if read[0] > BIGGEST or (kind == "MarkInflight" and read[1] > BIGGEST):
            raise CodecError("OutOfRange")
    return out


WINDOW_BITS = 8192


def encode_state(frontier: int, settled: list[int], inflight: dict[int, int], enqueued: dict[int, int]) -> bytes:
    """The snapshot blob of one queue; settled offsets beyond the window have no place in it."""
    bits = np.zeros(WINDOW_BITS, np.uint8)
    ahead = [o - frontier for o in settled if frontier <= o < frontier + WINDOW_BITS]
    bits[ahead] = 1
    window = np.packbits(bits, bitorder="little").tobytes()
    out = struct.pack(">QQI", frontier, frontier, len(window)) + window
    out += struct.pack(">I", len(inflight)) + b"".join(struct.pack(">QQ", *kv) for kv in sorted(inflight.items()))
    return out + struct.pack(">I", len(enqueued)) + b"".join(struct.pack(">QI", *kv) for kv in sorted(enqueued.items()))


def decode_state(blob: bytes) -> tuple[int, list[int], dict[int, int], dict[int, int]]:
    """(frontier, settled at or beyond it, inflight, enqueued); settled offsets are dropped from enqueued."""
    try:
        frontier, base, n = struct.unpack_from(">QQI", blob, 0)
        at = 20 + n
        settled = (np.flatnonzero(np.unpackbits(np.frombuffer(blob[20:at], np.uint8), bitorder="little")) + base).tolist()
        k = struct.unpack_from(">I", blob, at)[0]
        inflight = dict(struct.unpack_from(">QQ", blob, at + 4 + 16 * i) for i in range(k))
        at += 4 + 16 * k
        k = struct.unpack_from(">I", blob, at)[0]
        enqueued = dict(struct.unpack_from(">QI", blob, at + 4 + 12 * i) for i in range(k))
    except struct.error:
        raise CodecError("Truncated") from None
    done = set(settled)
    live = lambda o: o >= frontier and o not in done
    return frontier, settled, {o: d for o, d in inflight.items() if live(o)}, {o: r for o, r in enqueued.items() if live(o)}


def encode_snapshot(upto: int, blob: bytes) -> bytes:
    body = struct.pack(">HHQI", VERSION, 0, upto, len(blob)) + blob
    return SNAPSHOT_MAGIC + body + struct.pack(">I", crc32c(body))


def decode_snapshot(buf: bytes) -> tuple[int, bytes]:
    if len(buf) < 28:
        raise CodecError("Truncated")
    if buf[:8] != SNAPSHOT_MAGIC:
        raise CodecError("BadMagic")
    version, _, upto, n = struct.unpack_from(">HHQI", buf, 8)
    if version != VERSION:
        raise CodecError("BadVersion")
    if len(buf) < 28 + n:
        raise CodecError("Truncated")
    if crc32c(buf[8 : 24 + n]) != struct.unpack_from(">I", buf, 24 + n)[0]:
        raise CodecError("CrcMismatch")
    return upto, buf[24 : 24 + n]
