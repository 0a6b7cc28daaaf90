"""The segmented log as a Spark data source: batch and streaming reads, batch and streaming writes.

    register(spark)
    spark.read.format("tidemark").option("path", root).load()
    append(df, root)

Options: path; kind (messages, events); topic, part to narrow; corruption (resync, stop, fail); verifyCrc;
includePayload; decodeEvents (event columns instead of payloads); maxRecordsPerBatch and startingOffsets (earliest, latest) for
streams; splitBytes for reads; indexStride, segmentBytes, rollBatch (records that stay in one segment), commitId and lockSeconds for writes.

A log lives in ``<path>/<kind>/<topic>/<part>/segments``, on any file system that pyarrow opens; driver and executors must share it.
Filters on topic, part and offset prune logs and segments by their names, large segments are cut into byte ranges, and each task reads
its range only, from a sparse index entry on. Reading never changes a file: repair is logical, by stopping at the last good record.

Writing lays out new segments in a folder of the attempt, a batch of records at a time; the driver moves them into place in one commit.
Rows without an offset are numbered from the log's end. A commit that is brought again under the same commitId (streams: the
query's checkpoint and the batch number) has no effect; any other rows that lie below a log's end are refused with Conflict,
before anything is moved. A lost task or driver leaves nothing that is read, and a commit that broke off is replaced when it comes again.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import time
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tidemark.functions import codec
from tidemark.sources.store import IO, Conflict, LogError, Store

COLUMNS = ("topic", "part", "kind", "offset", "timestamp_ms", "flags", "headers", "payload", "segment_base", "file_pos")
SCHEMA = "topic string, part long, kind string, offset long, timestamp_ms long, flags int, headers binary, payload binary, segment_base long, file_pos long"
EVENT_SCHEMA = "topic string, part long, seq long, event_type string, off long, retries long, deadline long, requeue boolean, blob binary"
ARROW = pa.schema([("topic", pa.string()), ("part", pa.int64()), ("kind", pa.string()), ("offset", pa.int64()), ("timestamp_ms", pa.int64()), ("flags", pa.int32()), ("headers", pa.binary()), ("payload", pa.binary()), ("segment_base", pa.int64()), ("file_pos", pa.int64())])
EVENT_ARROW = pa.schema([("topic", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("event_type", pa.string()), ("off", pa.int64()), ("retries", pa.int64()), ("deadline", pa.int64()), ("requeue", pa.bool_()), ("blob", pa.binary())])
SAFE = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._-")
ROWS = 8192


SPLIT, OPEN, THREADS = 32 << 20, 64 << 10, 16


def component(name: str) -> str:
    return "".join(chr(b) if b in SAFE else f"%{b:02X}" for b in name.encode())


def log_dir(store: Store, kind: str, topic: str, part: int) -> str:
    return store.at(kind, component(topic), f"{part:010d}")


def segments(store: Store, log: str) -> list[tuple[int, int]]:
    """(base, bytes) of a log's segments, in order."""
    return [(int(name[:-4]), size) for name, size in store.entries(f"{log}/segments") if name.endswith(".log") and name[:-4].isdigit()]


def bases(store: Store, log: str) -> list[int]:
    return [base for base, _ in segments(store, log)]


def logs(store: Store, kind: str) -> list[tuple[str, int]]:
    """(topic, part) of each log there; a folder whose name isn't a number is an error."""
    found = []
    topics = [name for name, size in store.entries(store.at(kind)) if size is None]
    for name, parts in zip(topics, in_parallel(lambda t: store.entries(store.at(kind, t)), topics), strict=True):
        for part, _ in parts:
            if not part.isdigit():
                raise LogError("BadName", f"{name}/{part} is no partition folder")
            found.append((unquote(name), int(part)))
    return found


def in_parallel(f, items: list) -> list:
    """f of each item; listing and small reads wait for the store, so many are asked at a time."""
    if len(items) < 2:
        return [f(x) for x in items]
    with ThreadPoolExecutor(min(THREADS, len(items))) as pool:
        return list(pool.map(f, items))


def segment_path(log: str, base: int, kind: str = "log") -> str:
    return f"{log}/segments/{base:020d}.{kind}"


def index_of(store: Store, log: str, base: int) -> list[tuple[int, int]]:
    """(offset, byte position) at which reading a segment can begin."""
    entries = codec.read_index(store.read(segment_path(log, base, "idx")))
    return [(base, codec.SEGMENT_HEAD), *((base + rel, pos) for rel, pos in entries)]


def last_offset(store: Store, log: str, base: int) -> int | None:
    """The last good offset of a segment, read from its last index entry on."""
    starts = index_of(store, log, base)
    for _, pos in dict.fromkeys((starts[-1], starts[0])):
        last = None
        for _, r in codec.scan(store.read(segment_path(log, base), pos), 0, "stop", payload=False):
            last = r.offset
        if last is not None:
            return last
    return None


def watermarks(store: Store, log: str) -> dict:
    """head (first), tail (one past the last), durable (the last or None) of a log."""
    found, manifest = bases(store, log), store.read(f"{log}/manifest.bin")
    known = codec.decode_manifest(manifest) if manifest else {}
    for base in reversed(found):
        if (last := last_offset(store, log, base)) is not None:
            return {"head": found[0], "tail": last + 1, "durable": last}
    tail = max([known.get("next_offset", 0), *found[-1:]])
    return {"head": found[0] if found else known.get("head_offset", 0), "tail": tail, "durable": None}


@dataclass
class Piece(InputPartition):
    """Bytes of a segment and the offsets [low, high) wanted of them. Unless ``exact``, the task moves both ends to index entries."""

    def __init__(self, topic: str, part: int, base: int, begin: int, end: int | None, low: int, high: int | None, exact: bool, cost: int = 0):
        super().__init__(None)
        self.cost, self.reached, self.reason = cost, None, None
        self.whole = begin == 0 and end is None and not exact
        self.topic, self.part, self.base = topic, part, base
        self.begin, self.end, self.low, self.high, self.exact = begin, end, low, high, exact


class Options:
    def __init__(self, options: dict):
        get = lambda k, d: options.get(k, options.get(k.lower(), d))
        self.path = get("path", None)
        if not self.path:
            raise ValueError("the option path is missing")
        self.kind = get("kind", "messages")
        self.topic, self.part = get("topic", None), get("part", None)
        self.corruption = get("corruption", "resync")
        if self.corruption not in ("resync", "stop", "fail"):
            raise ValueError(f"corruption can't be {self.corruption}")
        true = lambda k, d: str(get(k, d)).lower() == "true"
        self.verify, self.payload, self.events = true("verifyCrc", "true"), true("includePayload", "true"), true("decodeEvents", "false")
        self.batch = int(get("maxRecordsPerBatch", 100_000))
        self.starting = get("startingOffsets", "earliest")
        self.stride, self.segment_bytes = int(get("indexStride", 65_536)), int(get("segmentBytes", 256 << 20))
        self.split, self.roll, self.lock = int(get("splitBytes", SPLIT)), max(1, int(get("rollBatch", 1))), float(get("lockSeconds", 600))
        where = get("checkpointLocation", None)
        self.commit_id = get("commitId", None) or (hashlib.sha256(where.encode()).hexdigest()[:24] if where else None)
        if self.events:
            self.kind, self.payload = "events", True

    @property
    def store(self) -> Store:
        return Store(self.path)

    def chosen(self) -> list[tuple[str, int]]:
        if self.topic is not None and self.part is not None:
            return [(self.topic, int(self.part))]
        return [(t, p) for t, p in logs(self.store, self.kind) if self.topic in (None, t) and self.part in (None, str(p))]


def read_piece(o: Options, x: Piece) -> Iterator[pa.RecordBatch]:
    store = o.store
    log = log_dir(store, o.kind, x.topic, x.part)
    path, begin, end, floor = segment_path(log, x.base), codec.SEGMENT_HEAD if x.whole else x.begin, x.end, 0 if o.corruption == "stop" else x.low
    if not x.exact and not x.whole:
        starts = index_of(store, log, x.base)
        mine = [s for s in starts if s[1] >= begin and (end is None or s[1] < end)]
        if not mine:
            return
        floor, begin = max(floor, mine[0][0]), mine[0][1]
        end = next((pos for _, pos in starts if end is not None and pos >= end), None)
    buf = store.read(path, 0 if x.whole else begin, end)
    if x.whole:  # one look at the file
        if not buf:
            return
        codec.check_segment(buf)
        buf = buf[codec.SEGMENT_HEAD :]
    else:
        head = store.read(path, 0, codec.SEGMENT_HEAD)
        if not head:
            return
        codec.check_segment(head)
    floor = max(floor, x.reached or 0)
    found = codec.frames(buf, 0, o.corruption, o.verify, ROWS)
    while True:
        try:
            starts, sizes = next(found)
        except StopIteration as e:
            x.reached, x.reason = floor, e.value
            return
        offsets, *rest = codec.columns(buf, starts, sizes, o.payload)
        past = np.flatnonzero(offsets >= x.high)[:1] if x.high is not None else []
        n = int(past[0]) if len(past) else len(offsets)
        # what lies before the range, or repeats behind a repair, is left out
        keep = np.flatnonzero(offsets[:n] > np.concatenate(([floor - 1], np.maximum(np.maximum.accumulate(offsets[:n]), floor - 1)[:-1])))
        if len(keep):
            floor = int(offsets[keep[-1]]) + 1
            wanted = keep[offsets[keep] >= x.low]
            if len(wanted):
                yield batch_of(o, x, wanted, offsets, begin + starts, *rest)
        if len(past):
            x.reached, x.reason = floor, "High"
            return


def batch_of(o: Options, x: Piece, at: np.ndarray, offsets: np.ndarray, places: np.ndarray, times: np.ndarray, flags: np.ndarray, headers: list, payloads: list | None) -> pa.RecordBatch:
    """The records ``at`` these places of a batch of frames."""
    n, some = len(at), at.tolist()
    if o.events:
        made = codec.decode_events([payloads[i] for i in some])
        return pa.RecordBatch.from_arrays([pa.array(offsets[at]) if f.name == "seq" else pa.array(made[f.name], f.type) for f in EVENT_ARROW], schema=EVENT_ARROW)
    same = lambda v, f: pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([v], ARROW.field(f).type)).dictionary_decode()
    made = [same(x.topic, "topic"), same(x.part, "part"), same(o.kind, "kind"), pa.array(offsets[at]), pa.array(times[at]), pa.array(flags[at]), pa.array([headers[i] for i in some], pa.binary()), pa.array([payloads[i] for i in some], pa.binary()) if o.payload else pa.nulls(n, pa.binary()), same(x.base, "segment_base"), pa.array(places[at])]
    return pa.RecordBatch.from_arrays(made, schema=ARROW)


@dataclass
class Chain(InputPartition):
    """Pieces of one log that a task reads one after the other."""

    def __init__(self, parts: list[Piece]):
        super().__init__(None)
        self.parts, self.base, self.begin = parts, parts[0].base, parts[0].begin


def read_chain(o: Options, x: Piece | Chain) -> Iterator[pa.RecordBatch]:
    """All pieces of a chain. Reading that stops at a bad record leaves out what follows in the log, unless the next segment goes on where the good records end."""
    parts, reached = x.parts if isinstance(x, Chain) else [x], None
    for i, p in enumerate(parts):
        p.reached, p.reason = reached, None
        yield from read_piece(o, p)
        if o.corruption == "stop":
            reached = p.reached if p.reached is not None else reached
            if p.reason and not (i + 1 < len(parts) and parts[i + 1].base == reached):
                return


def packed(o: Options, found: list[Piece]) -> list[Piece | Chain]:
    """Small pieces of a log go to one task, as many as ``split`` bytes allow, each counted with OPEN bytes more; with 'stop' a log is one chain, as what counts depends on all before."""
    out, held, size = [], [], 0
    for p in found:
        cost = OPEN + p.cost
        if held and size + cost > o.split and o.corruption != "stop":
            out.append(held)
            held, size = [], 0
        held.append(p)
        size += cost
    return [h[0] if len(h) == 1 else Chain(h) for h in ([*out, held] if held else out)]


def pieces(o: Options, topic: str, part: int, low: int, high: int | None, from_head: bool = False) -> list[Piece]:
    """Byte ranges that cover the offsets [low, high) of a log.

    Names and sizes of segments are all that is needed for those that are wanted as a whole; an index is read here only where a
    range begins or ends within a segment. Where reading stops at a bad record, ``from_head`` has all that comes before the range looked at too.
    """
    store = o.store
    log = log_dir(store, o.kind, topic, part)
    found, out = segments(store, log), []
    start = 0 if o.corruption == "stop" and from_head else low
    for i, (base, size) in enumerate(found):
        until = found[i + 1][0] if i + 1 < len(found) else None
        if (until is not None and until <= start) or (high is not None and base >= high):
            continue
        top = min((x for x in (high, until) if x is not None), default=None)
        begin, end, exact = 0, size, False
        if start > base or (high is not None and (until is None or high < until)):
            starts = index_of(store, log, base)
            begin = starts[max(0, bisect_right([s[0] for s in starts], start) - 1)][1]
            end = next((pos for off, pos in starts if high is not None and off >= high), size)
            exact = end - begin <= o.split
        for at in [begin] if exact else range(begin, end, o.split):
            to = end if exact or at + o.split >= end else at + o.split
            out.append(Piece(topic, part, base, at, None if to >= size else to, low, top, exact, to - at))
    return out


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = Options(options)
        self.topics: set | None = None
        self.parts: set | None = None
        self.low, self.high = 0, None

    def partitions(self):
        wanted = [(t, p) for t, p in self.o.chosen() if (self.topics is None or t in self.topics) and (self.parts is None or p in self.parts)]
        if self.high is not None and self.low >= self.high:
            wanted = []
        found = in_parallel(lambda w: packed(self.o, pieces(self.o, *w, self.low, self.high, True)), wanted)
        return [x for p in found for x in p] or [Piece("", 0, -1, 0, 0, 0, 0, True)]

    def read(self, partition):
        if partition.base >= 0:
            yield from read_chain(self.o, partition)


class PushingReader(LogReader):
    def pushFilters(self, filters):
        """Takes over filters on topic, part and offset; the others stay with Spark."""
        at = "seq" if self.o.events else "offset"
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if name == "topic" and values is not None:
                self.topics = values if self.topics is None else self.topics & values
            elif name == "part" and values is not None:
                self.parts = values if self.parts is None else self.parts & values
            elif name == at and isinstance(f, EqualTo):
                self._within(f.value, f.value + 1)
            elif name == at and isinstance(f, GreaterThan):
                self._within(f.value + 1, None)
            elif name == at and isinstance(f, GreaterThanOrEqual):
                self._within(f.value, None)
            elif name == at and isinstance(f, LessThan):
                self._within(0, f.value)
            elif name == at and isinstance(f, LessThanOrEqual):
                self._within(0, f.value + 1)
            else:
                yield f

    def _within(self, low: int, high: int | None) -> None:
        self.low = max(self.low, low)
        self.high = high if self.high is None else self.high if high is None else min(self.high, high)


class LogStreamReader(DataSourceStreamReader):
    """Offsets are {"topic/part": next offset}; each micro-batch reads up to maxRecordsPerBatch of each log."""

    def __init__(self, options: dict):
        self.o = Options(options)
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        if self.o.starting == "latest":
            return self._tails()
        store, wanted = self.o.store, self.o.chosen()
        found = in_parallel(lambda w: min(bases(store, log_dir(store, self.o.kind, *w)), default=0), wanted)
        return {self._key(t, p): n for (t, p), n in zip(wanted, found, strict=True)}

    def latestOffset(self) -> dict:
        tails = self._tails()
        if self.at is None:
            self.at = self.initialOffset()
        out = {k: max(self.at.get(k, 0), min(tail, self.at.get(k, 0) + self.o.batch)) for k, tail in tails.items()}
        self.at = out
        return out

    def _key(self, topic: str, part: int) -> str:
        return f"{component(topic)}/{part}"

    def _tails(self) -> dict:
        store, wanted = self.o.store, self.o.chosen()
        found = in_parallel(lambda w: watermarks(store, log_dir(store, self.o.kind, *w))["tail"], wanted)
        return {self._key(t, p): n for (t, p), n in zip(wanted, found, strict=True)}

    def partitions(self, start: dict, end: dict):
        self.at = {**end, **(self.at or {})}
        out = []
        for key, high in end.items():
            name, part = key.rsplit("/", 1)
            low = start.get(key, 0)
            if high > low:
                out.extend(packed(self.o, pieces(self.o, unquote(name), int(part), low, high)))
        return out

    def read(self, partition):
        yield from read_chain(self.o, partition)

    def commit(self, end: dict) -> None:
        """Nothing to do: the log keeps its records until retention drops them."""


@dataclass
class Laid(WriterCommitMessage):
    """What a task has laid out: (topic, part, folder, bases, first offset, next offset, records)."""

    made: list


class Layout:
    """Lays out the records of one log as segments in ``folder``, a batch at a time: no more than a batch and an index are held."""

    def __init__(self, o: Options, store: Store, folder: str, topic: str, part: int, now: int):
        self.o, self.store, self.folder, self.topic, self.part, self.now = o, store, folder, topic, part, now
        self.bases: list[int] = []
        self.first = self.next = None
        self.n, self.size, self.file = 0, 0, None
        self.waiting: list[list] = []

    def number(self, n: int) -> range:
        """Offsets for the next ``n`` records, from the log's end on."""
        at = self.next if self.next is not None else watermarks(self.store, log_dir(self.store, self.o.kind, self.topic, self.part))["tail"]
        return range(at, at + n)

    def add(self, records: list[codec.Record]) -> None:
        self.add_columns(*map(list, zip(*((r.offset, r.timestamp_ms, r.flags, r.headers or b"", r.payload or b"") for r in records), strict=True)))

    def add_columns(self, *columns: list) -> None:
        """Offsets, timestamps, flags, headers and payloads of the next records."""
        offsets = columns[0]
        if not offsets:
            return
        for before, r in itertools.pairwise(offsets if self.next is None else [self.next - 1, *offsets]):
            if r <= before:
                raise Conflict("OutOfOrder", f"{self.topic}/{self.part}: offset {r} after {before}")
        self.first = offsets[0] if self.first is None else self.first
        self.next = offsets[-1] + 1
        self.n += len(offsets)
        if self.waiting and self.waiting[0]:
            columns = [[*w, *c] for w, c in zip(self.waiting, columns, strict=True)]
        whole = len(columns[0]) // self.o.roll * self.o.roll
        self._lay(*[c[:whole] for c in columns] if whole < len(columns[0]) else columns)
        self.waiting = [c[whole:] for c in columns]

    def _lay(self, offsets: list, *columns: list) -> None:
        """Write records; a segment is as many groups of ``roll`` records as fit, one at least."""
        n = len(offsets)
        if not n:
            return
        buf, ends = codec.encode_columns(offsets, *columns)
        view, starts, groups = memoryview(buf), np.concatenate(([0], ends[:-1])), np.append(np.arange(self.o.roll, n, self.o.roll), n)
        group_ends, g = ends[groups - 1], 0
        while g < len(groups):
            i = int(groups[g - 1]) if g else 0
            begin = int(starts[i])
            if self.file is None:
                self._roll(offsets[i])
            to = int(np.searchsorted(group_ends, begin + self.o.segment_bytes - self.size, side="right"))
            if to <= g:
                if self.size > codec.SEGMENT_HEAD:
                    self._roll(offsets[i])
                    continue
                to = g + 1
            j, shift = int(groups[to - 1]), self.size - begin
            k = max(i, int(np.searchsorted(starts, self.mark + self.o.stride - shift)))
            while k < j:
                self.mark = int(starts[k]) + shift
                self.index.add(offsets[k], self.mark)
                k = max(k + 1, int(np.searchsorted(starts, self.mark + self.o.stride - shift)))
            self.file.write(view[begin : int(ends[j - 1])])
            self.size += int(ends[j - 1]) - begin
            IO["bytes_written"] += int(ends[j - 1]) - begin
            g = to

    def _roll(self, base: int) -> None:
        self._seal()
        self.bases.append(base)
        self.open = self.store.create(segment_path(self.folder, base), forced=False)
        self.file = self.open.__enter__()
        self.file.write(codec.segment_head(base, self.now))
        self.index, self.size, self.mark = codec.IndexWriter(base, self.now), codec.SEGMENT_HEAD, codec.SEGMENT_HEAD

    def _seal(self) -> None:
        if self.file is not None:
            self.open.__exit__(None, None, None)
            with self.store.create(segment_path(self.folder, self.bases[-1], "idx"), forced=False) as f:
                f.write(self.index.bytes())

    def close(self) -> tuple:
        if self.waiting:
            self._lay(*self.waiting)
        self._seal()
        self.store.force([segment_path(self.folder, base, kind) for base in self.bases for kind in ("log", "idx")])
        return self.topic, self.part, self.folder, self.bases, self.first, self.next, self.n


class LogWriter(DataSourceArrowWriter, DataSourceStreamArrowWriter):
    """Rows need topic, part and payload; offset, timestamp_ms, flags and headers may be missing. Without offsets rows are numbered as they come.

    The rows of a log must come to one task and in order: append() sees to that, or
    ``df.repartition("topic", "part").sortWithinPartitions("topic", "part", "offset")``.
    """

    def __init__(self, options: dict, columns: list[str], overwrite: bool = False):
        self.o, self.columns, self.overwrite = Options(options), columns, overwrite
        self.attempt = uuid.uuid4().hex

    @property
    def stage(self) -> str:
        return self.o.store.at("tmp", self.attempt)

    def write(self, iterator) -> Laid:
        store, now, made, current = self.o.store, int(time.time() * 1000), [], None
        own = f"{self.stage}/{uuid.uuid4().hex}"
        for whole in iterator:
            for b in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                cols = {c: b.column(i) for i, c in enumerate(b.schema.names) if c in ("topic", "part", "offset", "timestamp_ms", "flags", "headers", "payload")}
                codes, parts = cols["topic"].dictionary_encode().indices.to_numpy(zero_copy_only=False), cols["part"].to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(parts) != 0)) + 1).tolist(), b.num_rows]
                cols = {c: v.to_pylist() for c, v in cols.items() if c not in ("topic", "part")} | {c: cols[c] for c in ("topic", "part")}
                for at, to in itertools.pairwise(edges):
                    key, n, part = (cols["topic"][at].as_py(), cols["part"][at].as_py()), to - at, slice(at, to)
                    get = lambda c, spare, cols=cols, part=part, n=n: [spare if v is None else v for v in cols[c][part]] if c in cols else [spare] * n
                    if current is None or (current.topic, current.part) != key:
                        if current is not None:
                            made.append(current.close())
                        current = Layout(self.o, store, f"{own}/{len(made)}", *key, now)
                    if "offset" in cols:
                        offsets = cols["offset"][part]
                    elif self.overwrite:
                        offsets = list(range(current.next or 0, (current.next or 0) + n))
                    else:
                        offsets = list(current.number(n))
                    texts = [[x.encode() if isinstance(x, str) else x for x in get(c, b"")] for c in ("headers", "payload")]
                    current.add_columns(offsets, get("timestamp_ms", now), get("flags", 0), *texts)
        if current is not None:
            made.append(current.close())
        return Laid(made)

    def commit(self, messages, batch_id: int | None = None) -> None:
        store, o = self.o.store, self.o
        made = sorted((x for m in messages if m for x in m.made), key=lambda x: (x[0], x[1], x[4]))
        with store.lock(store.at("locks", f"{o.kind}.lock"), o.lock):
            old = store.at("tmp", f"old-{self.attempt}")
            if self.overwrite and store.exists(store.at(o.kind)):
                store.move(store.at(o.kind), old)
            try:
                publish(o, store, made, o.commit_id or self.attempt, batch_id or 0)
            except Exception:
                if self.overwrite and store.exists(old):
                    store.remove_tree(store.at(o.kind))
                    store.move(old, store.at(o.kind))
                raise
            finally:
                store.remove_tree(self.stage)
            store.remove_tree(old)

    def abort(self, messages, batch_id: int | None = None) -> None:
        self.o.store.remove_tree(self.stage)


def commit_path(log: str, commit_id: str) -> str:
    return f"{log}/commits/{component(commit_id)}.json"


def known_commit(store: Store, log: str, commit_id: str) -> dict | None:
    """What a log knows of a commit: batch, done, bases, first, next, n."""
    found = store.read(commit_path(log, commit_id))
    return json.loads(found) if found else None


def publish(o: Options, store: Store, made: list[tuple], commit_id: str, batch: int) -> None:
    """Move laid-out segments (in order of log and offset) into their logs. All logs are checked before anything is moved."""
    todo = []
    for (topic, part), group in itertools.groupby(made, key=lambda x: x[:2]):
        log, group = log_dir(store, o.kind, topic, part), [x for x in group if x[6]]
        if not group:
            continue
        known = known_commit(store, log, commit_id)
        if known and (known["batch"] > batch or (known["batch"] == batch and known["done"])):
            continue
        if known and not known["done"]:  # it broke off: what it had moved goes
            for base in known["bases"]:
                for suffix in ("log", "idx"):
                    store.remove(segment_path(log, base, suffix))
        for x, y in itertools.pairwise(group):
            if y[4] < x[5]:
                raise Conflict("Overlap", f"{topic}/{part}: [{x[4]}, {x[5]}) and [{y[4]}, {y[5]}) came from different tasks; deal rows by topic and part")
        tail = watermarks(store, log)["tail"]
        if group[0][4] < tail:
            raise Conflict("Overlap", f"{topic}/{part}: offsets from {group[0][4]} on, but the log goes to {tail}")
        todo.append((log, group))

    def move(x: tuple) -> None:
        log, group = x
        record = {"batch": batch, "done": False, "bases": [b for x in group for b in x[3]], "first": group[0][4], "next": group[-1][5], "n": sum(x[6] for x in group)}
        store.put(commit_path(log, commit_id), json.dumps(record).encode())
        for _, _, folder, found, *_ in group:
            for base in found:
                for suffix in ("idx", "log"):  # a segment counts once its log is there
                    store.move(segment_path(folder, base, suffix), segment_path(log, base, suffix))
        store_manifest(o, store, log, group[-1][5])
        store.put(commit_path(log, commit_id), json.dumps({**record, "done": True}).encode())

    in_parallel(move, todo)


def store_manifest(o: Options, store: Store, log: str, nxt: int) -> None:
    found, now, old = bases(store, log), int(time.time() * 1000), store.read(f"{log}/manifest.bin")
    known = codec.decode_manifest(old) if old else {}
    store.put(f"{log}/manifest.bin", codec.encode_manifest(known.get("created_ms", now), o.segment_bytes, o.stride, found[-1] if found else nxt, max(nxt, known.get("next_offset", 0)), found[0] if found else nxt))


def truncate_before(root: str, kind: str, topic: str, part: int, before: int) -> int:
    """Delete sealed segments whose records all lie before ``before``; the head that remains."""
    store = Store(root)
    log = log_dir(store, kind, topic, part)
    found = bases(store, log)
    for base, nxt in itertools.pairwise(found):
        if nxt - 1 >= before:
            break
        for suffix in ("idx", "log"):
            store.remove(segment_path(log, base, suffix))
    left = bases(store, log)
    if left and left != found:
        store_manifest(Options({"path": root}), store, log, 0)
    return left[0] if left else 0


def cleanup(frontiers: DataFrame, root: str, kind: str = "messages") -> DataFrame:
    """(topic, part, before, head): truncate each queue's log before its frontier (topic, part, acked_until), by the executors."""
    from tidemark.sources.shared import cut

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            heads = in_parallel(lambda r: truncate_before(root, kind, r["topic"], r["part"], r["before"]), rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, pa.int64())], names=["topic", "part", "before", "head"])

    cutoffs = frontiers.selectExpr("topic", "cast(part as bigint) as part", "cast(acked_until as bigint) as before")
    cutoffs = cutoffs.repartition(frontiers.sparkSession.sparkContext.defaultParallelism, "topic", "part")  # few rows, each of much work
    return cut(cutoffs.mapInArrow(run, "topic string, part long, before long, head long"))


def ends(spark: SparkSession, root: str, kind: str = "messages", commit_id: str | None = None) -> DataFrame:
    """(topic, part, next_off): where each log goes on. With ``commit_id``, where that commit began if it was made before."""
    store = Store(root)

    def end(key: tuple[str, int]) -> int:
        log = log_dir(store, kind, *key)
        known = known_commit(store, log, commit_id) if commit_id else None
        return known["first"] if known else watermarks(store, log)["tail"]

    found = logs(store, kind)
    rows = [(t, p, n) for (t, p), n in zip(found, in_parallel(end, found), strict=True)]
    return spark.createDataFrame(rows, "topic string, part long, next_off long")


def status(spark: SparkSession, root: str, kind: str = "messages") -> DataFrame:
    """(topic, part, head, tail, durable, segments, bytes) of each log, from its files."""
    store = Store(root)

    def one(key: tuple[str, int]) -> tuple:
        log = log_dir(store, kind, *key)
        found, at = segments(store, log), watermarks(store, log)
        return (*key, at["head"], at["tail"], at["durable"], len(found), sum(size for _, size in found))

    return spark.createDataFrame(in_parallel(one, logs(store, kind)), "topic string, part long, head long, tail long, durable long, segments long, bytes long")


def append(df: DataFrame, root: str, order: list[str] | None = None, kind: str = "messages", commit_id: str | None = None, spread: bool = True, prepare=None, **options) -> DataFrame:
    """Append rows in one commit; (topic, part, first_offset, next_offset, n) of each log once they are on disk.

    ``df`` is numbered from the log's end in ``order``, or has offsets already. Called again with the same ``commit_id`` it appends
    nothing and gives the same answer. Rows are dealt by ranges of offsets, each laid out as segments of its own, so a log that gets
    most of the rows is written by many tasks; with ``spread`` off, or without an order, each log is written by one task.
    ``prepare`` makes the payload of rows once they are numbered and dealt; it keeps topic, part and offset.
    """
    from tidemark.operators.scans import placed_offsets

    spark, own = df.sparkSession, commit_id or f"append-{uuid.uuid4().hex}"
    register(spark)
    prepare, ranges = prepare or (lambda rows: rows), False
    if "offset" not in df.columns and order:
        keys = [c for c in order if c not in ("topic", "part")]
        df, ranges = placed_offsets(df, keys, ends(spark, root, kind, commit_id))
        df = df.withColumnRenamed("off", "offset")
    by = ["topic", "part", *(["offset"] if "offset" in df.columns else [])]
    # numbered rows lie in ranges of offsets already
    dealt = df if spread and ranges else df.repartitionByRange(*by) if spread and len(by) > 2 else df.repartition("topic", "part")
    prepare(dealt).sortWithinPartitions(*by).write.format("tidemark").options(path=root, kind=kind, commitId=own, **options).mode("append").save()
    store = Store(root)
    found = logs(store, kind)
    known = in_parallel(lambda k: known_commit(store, log_dir(store, kind, *k), own), found)
    if commit_id is None:  # nobody can bring it again
        in_parallel(lambda k: store.remove(commit_path(log_dir(store, kind, *k), own)), found)
    return spark.createDataFrame([(t, p, r["first"], r["next"], r["n"]) for (t, p), r in zip(found, known, strict=True) if r], "topic string, part long, first_offset long, next_offset long, n long")


class LogDataSource(DataSource):
    """Works with Spark's default settings; register() adds filters that prune segments."""

    reading = LogReader

    @classmethod
    def name(cls) -> str:
        return "tidemark"

    def schema(self) -> str:
        return EVENT_SCHEMA if Options(self.options).events else SCHEMA

    def reader(self, schema) -> LogReader:
        return self.reading(self.options)

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self.options, schema.names, overwrite)

    def streamWriter(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self.options, schema.names, overwrite)


class PushingLogDataSource(LogDataSource):
    reading = PushingReader


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters that are taken over by the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PushingLogDataSource)
