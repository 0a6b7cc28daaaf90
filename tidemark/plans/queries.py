"""The engine's own queries over logs and queues, and the SQL they are held against."""

from __future__ import annotations

import atexit
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec, crc, scalars
from tidemark.operators import batching, fold, replay, scans, snapshots, state
from tidemark.operators.events import append_events
from tidemark.plans import derive
from tidemark.schemas import QUEUE
from tidemark.sources import log
from tidemark.sources.shared import cut, shared_folder
from tidemark.sources.store import Store

SEGMENT_RECORDS = 50


class Source:
    """The derived tables of a directory; each is planned once for a query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.messages = derive.messages(spark, sf_dir)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def events(self) -> DataFrame:
        return derive.queue_events(self.messages)

    @property
    def acks(self) -> DataFrame:
        return derive.queue_events(self.messages, "b")

    @property
    def state(self) -> DataFrame:
        return replay.offset_state(self.events)

    def frontiers(self, st: DataFrame) -> DataFrame:
        return replay.frontier(st.filter("settled"))

    @property
    def queues(self) -> DataFrame:
        return self.messages.select(*QUEUE).distinct()

    @property
    def log(self) -> DataFrame:
        """Messages in segments of SEGMENT_RECORDS records, some of them lost."""
        m = self.messages.withColumn("segment_base", (F.floor(F.col("off") / SEGMENT_RECORDS) * SEGMENT_RECORDS).cast("long"))
        return m.filter("event_id % 13 <> 5")

    def now(self) -> int:
        """The middle of the messages' times."""
        return self.messages.agg(F.floor((F.min("ts_ms") + F.max("ts_ms")) / 2)).first()[0] or 0


def queue_summary(s: Source) -> DataFrame:
    return replay.queue_state(cut(s.events))


def ack_frontier(s: Source) -> DataFrame:
    return state.lowest_unacked(s.queues, s.frontiers(replay.offset_state(s.acks)))


def offset_state(s: Source) -> DataFrame:
    return s.state


def offset_state_fold(s: Source) -> DataFrame:
    return fold.fold_state(s.events)


def is_acked_lookup(s: Source) -> DataFrame:
    st = cut(s.state)
    return state.lookup(s.messages.select(*replay.OFFSET), st, s.frontiers(st))


def inflight_dump(s: Source) -> DataFrame:
    return state.inflight(s.state)


def inflight_count(s: Source) -> DataFrame:
    return state.inflight_count(s.queues, s.state)


def next_expiry_hint(s: Source) -> DataFrame:
    return state.next_expiry(s.state, QUEUE)


def next_expiry_hint_global(s: Source) -> DataFrame:
    return state.next_expiry(s.state, [])


def list_expired(s: Source) -> DataFrame:
    return state.expired(s.state, s.now(), 100)


def expired_top_k_per_queue(s: Source) -> DataFrame:
    return state.expired_per_queue(s.state, s.now(), 5)


def next_deliverable(s: Source) -> DataFrame:
    st = cut(s.state)
    sizes = s.messages.groupBy(*QUEUE).agg(F.count("*").alias("n"))
    asked = sizes.select(*QUEUE, F.explode(F.array(F.lit(0).cast("long"), F.floor(F.col("n") / 3), F.floor(F.col("n") / 2))).alias("start"), F.col("n").alias("upper")).distinct()
    return state.next_deliverable(asked, st, s.frontiers(st))


def ready_semi_join(s: Source) -> DataFrame:
    return state.keep_enqueued(s.messages.select(*replay.OFFSET, "ts_ms"), s.state)


def ready_messages(s: Source) -> DataFrame:
    return state.keep_enqueued(s.messages.select(*replay.OFFSET, "ts_ms"), s.state.filter("not settled"))


def fetch_available_anti_join(s: Source) -> DataFrame:
    return state.available(s.messages.select(*replay.OFFSET, "ts_ms"), s.state, 10, 20)


def retry_counts(s: Source) -> DataFrame:
    return s.state.filter("enqueued").groupBy(*QUEUE, "retries").agg(F.count("*").alias("n"))


def dead_letters(s: Source) -> DataFrame:
    return replay.settlements(s.events).filter("reason in ('dead_letter', 'nack')")


def retry_exhausted(s: Source) -> DataFrame:
    return replay.settlements(s.events).filter("reason = 'retries_exhausted'").select(*replay.OFFSET, "seq")


def settlement_reasons(s: Source) -> DataFrame:
    return replay.settlements(s.events).groupBy(*QUEUE, "reason").agg(F.count("*").alias("n"))


def out_of_order_acks(s: Source) -> DataFrame:
    st = cut(s.state)
    return state.out_of_order(st, s.frontiers(st))


def ack_bitmap_sizes(s: Source) -> DataFrame:
    st = cut(replay.offset_state(s.acks))
    bits = state.ack_bitmap(st, s.frontiers(st))
    return bits.groupBy(*QUEUE).agg(F.sum(F.bitmap_count("bits")).cast("long").alias("n_ahead"))


def offset_gaps(s: Source) -> DataFrame:
    return scans.gaps(s.log)


def list_queues(s: Source) -> DataFrame:
    return s.events.select(*QUEUE).distinct()


def list_topics(s: Source) -> DataFrame:
    return s.events.select("topic").distinct()


def validate_violations(s: Source) -> DataFrame:
    st = cut(s.state)
    return state.violations(st, s.frontiers(st))


def canonical_dump(s: Source) -> DataFrame:
    ev = cut(s.events)
    st = cut(replay.offset_state(ev))
    image = state.canonical(st, replay.queue_state(ev, st))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    pairs = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[a].cast("string"), x[b].cast("string"))), ",")
    return image.select(*QUEUE, "acked_until", text("ahead").alias("ahead"), pairs("inflight", "off", "deadline").alias("inflight"), pairs("enqueued", "off", "retries").alias("enqueued"))


def safe_truncate_before(s: Source) -> DataFrame:
    fr = state.lowest_unacked(s.queues, s.frontiers(replay.offset_state(s.acks)))
    return fr.groupBy("topic").agg(F.min("acked_until").alias("safe_before"))


def scan_from(s: Source) -> DataFrame:
    return scans.scan_from(s.messages, "click", 1, 10, 50).select(*replay.OFFSET, "ts_ms", F.decode("payload", "utf-8").alias("payload"))


def fetch_by_offset(s: Source) -> DataFrame:
    return scans.fetch(s.messages, "view", 2, 7).select(*replay.OFFSET, "ts_ms", "flags", F.decode("payload", "utf-8").alias("payload"))


def head_tail_watermarks(s: Source) -> DataFrame:
    return scans.watermarks(s.log)


def segment_list(s: Source) -> DataFrame:
    return scans.segments(s.log)


def segment_floor_lookup(s: Source) -> DataFrame:
    asked = s.log.select(*replay.OFFSET)
    return scans.segment_of(asked, scans.segments(s.log))


def segment_assignment(s: Source) -> DataFrame:
    return scans.layout(s.messages, 16_384, 2048, 16)


def sparse_index_entries(s: Source) -> DataFrame:
    return scans.layout(s.messages, 16_384, 2048, 16).filter("indexed").drop("indexed")


def index_seek(s: Source) -> DataFrame:
    placed = scans.layout(s.messages, 16_384, 2048, 16)
    return scans.seek(placed.select(*replay.OFFSET, "segment_base"), placed.filter("indexed"))


def record_positions(s: Source) -> DataFrame:
    return scans.sized(s.log).select(*replay.OFFSET, "segment_base", "size", "file_pos")


def record_bytes_len(s: Source) -> DataFrame:
    return s.messages.groupBy(*QUEUE).agg(F.sum(scalars.record_size(F.col("headers"), F.col("payload"))).alias("bytes"), F.count("*").alias("records"))


def retention_deletable_segments(s: Source) -> DataFrame:
    cut = state.lowest_unacked(s.queues, s.frontiers(replay.offset_state(s.acks))).withColumnRenamed("acked_until", "before")
    return scans.deletable(scans.segments(s.log), cut)


def retention_new_heads(s: Source) -> DataFrame:
    segs = scans.segments(s.log)
    cut = state.lowest_unacked(s.queues, s.frontiers(replay.offset_state(s.acks))).withColumnRenamed("acked_until", "before")
    return scans.heads_after(segs, scans.deletable(segs, cut).select(*QUEUE, "base"))


def offset_assignment(s: Source) -> DataFrame:
    nxt = s.messages.filter("event_id < 100").groupBy(*QUEUE).agg((F.max("off") + 1).alias("next_off"))
    new = s.messages.filter("event_id >= 100").select(*QUEUE, "event_id")
    return scans.assign_offsets(new, ["event_id"], nxt)


def batch_linger_sessions(s: Source) -> DataFrame:
    return batching.linger_sessions(s.messages, QUEUE, "ts_ms", ["off"], 3_600_000)


def batch_flush_reasons(s: Source) -> DataFrame:
    sized = s.messages.withColumn("size", scalars.record_size(F.col("headers"), F.col("payload")))
    return batching.flushes(sized, QUEUE, "ts_ms", "off", "size", 1000, 16, 1200, 3_600_000)


def monotonic_clock(s: Source) -> DataFrame:
    jittered = s.messages.withColumn("clock", F.col("ts_ms") + F.col("event_id") * 7919 % 5_000_000)
    return scans.monotonic(jittered.select(*replay.OFFSET, "clock"), "clock", QUEUE, ["off"])


def names(s: Source) -> DataFrame:
    """Names to be checked: parts' types as they are and in forms that are, or nearly are, topics."""
    p = s.table("part")
    dashed = F.regexp_replace(F.lower("p_type"), "[^a-z0-9]+", ".")
    forms = F.array(F.col("p_type"), dashed, F.concat(F.lit("."), dashed), F.concat(dashed, F.lit("..x")), F.concat(F.lower("p_name"), F.lit("..y")), F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")), F.lit(""), F.repeat(dashed, 20), F.concat(dashed, F.lit("..É")))
    return p.select(F.explode(forms).alias("name")).distinct()


def topic_validate(s: Source) -> DataFrame:
    return names(s).select("name", scalars.is_topic(F.col("name")).alias("ok"))


def topic_error_class(s: Source) -> DataFrame:
    return names(s).select("name", scalars.topic_error(F.col("name")).alias("error"))


def path_encode(s: Source) -> DataFrame:
    rows = s.table("documents").select("doc_id", F.concat("text", F.lit("*~+/ %")).alias("name"))
    return rows.select("doc_id", scalars.path_component(F.col("name")).alias("component"))


def segment_file_names(s: Source) -> DataFrame:
    segs = s.log.select(*QUEUE, "segment_base").distinct()
    return segs.select(*QUEUE, scalars.segment_name(F.col("segment_base")).alias("log_name"), scalars.index_name(F.col("segment_base")).alias("idx_name"), scalars.part_name(F.col("part")).alias("part_dir"))


def durability_levels(s: Source) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, ("AfterWrite", "AfterFsync", "AfterReplicated"))), (F.col("event_id") % 3 + 1).cast("int"))
    rows = s.messages.select(scalars.effective_durability(level).alias("effective"))
    return rows.groupBy("effective").agg(F.count("*").alias("n"))


def codec_roundtrip(s: Source) -> DataFrame:
    """Records framed and read back: what comes out, and whether every frame was whole."""
    rows = s.messages.select(*replay.OFFSET, "ts_ms", "flags", "headers", "payload")

    def run(batches):
        for b in batches:
            d = b.to_pydict()
            made = codec.encode_records([codec.Record(o, t, f, h, p) for o, t, f, h, p in zip(d["off"], d["ts_ms"], d["flags"], d["headers"], d["payload"], strict=True)])
            back = [r for _, r in codec.scan(b"".join(made), 0, "fail")]
            yield pa.RecordBatch.from_pydict({"topic": d["topic"], "part": d["part"], "off": [r.offset for r in back], "ts_ms": [r.timestamp_ms for r in back], "flags": [r.flags for r in back], "payload_md5": [hashlib.md5(r.payload).hexdigest() for r in back], "size": [len(m) for m in made]}, schema=pa.schema([("topic", pa.string()), ("part", pa.int64()), ("off", pa.int64()), ("ts_ms", pa.int64()), ("flags", pa.int32()), ("payload_md5", pa.string()), ("size", pa.int64())]))

    return rows.mapInArrow(run, "topic string, part long, off long, ts_ms long, flags int, payload_md5 string, size long")


def event_codec_roundtrip(s: Source) -> DataFrame:
    cols = [*QUEUE, "seq", "event_type", "off", "retries", "deadline", "requeue"]

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            back = [codec.decode_event(codec.encode_event(r["event_type"], r["topic"], r["part"], r["off"], r["retries"], r["deadline"], r["requeue"])) for r in rows]
            yield pa.RecordBatch.from_pylist([{**{c: x[c] for c in cols if c != "seq"}, "seq": r["seq"]} for x, r in zip(back, rows, strict=True)], schema=b.schema)

    ev = s.events.select(*cols)
    return ev.mapInArrow(run, "topic string, part long, seq long, event_type string, off long, retries long, deadline long, requeue boolean")


def crc32c_check(s: Source) -> DataFrame:
    """CRC-32C of payloads by the batch form, and whether it agrees with the form that goes byte by byte."""
    def run(batches):
        table = crc.byte_table().tolist()
        for b in batches:
            values = b.column(1).to_pylist()
            slow = []
            for v in values:
                r = 0xFFFFFFFF
                for byte in v:
                    r = table[(r ^ byte) & 255] ^ (r >> 8)
                slow.append(r ^ 0xFFFFFFFF)
            fast = crc.crc32c_many(values).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x == y for x, y in zip(slow, fast, strict=True)])], names=["event_id", "agrees"])

    return s.messages.select("event_id", "payload").mapInArrow(run, "event_id long, agrees boolean")


def incremental_replay(s: Source) -> DataFrame:
    """State from snapshots in the middle of each queue plus the later events."""
    return halved(cut(s.events))


def halved(ev: DataFrame) -> DataFrame:
    cuts = ev.groupBy(*QUEUE).agg(F.floor((F.max("seq") + 1) / 2).cast("long").alias("upto"))
    return replay.resume(replay.snapshot(ev, cuts), cuts, ev)


def incremental_replay_equals_full(s: Source) -> DataFrame:
    """Offsets in which the two differ; there are none."""
    ev = cut(s.events)
    a, b = halved(ev), replay.offset_state(ev)
    return a.exceptAll(b).union(b.exceptAll(a))


COLUMNS = ("topic", "part", "offset", "timestamp_ms", "flags", "payload")


def folder(s: Source) -> str:
    """A folder for a query's log; it goes when the driver ends."""
    path = f"{shared_folder(s.spark)}/log-{uuid.uuid4().hex}"
    store = Store(path)
    atexit.register(store.remove_tree, store.root)
    return path


def stored(s: Source, rows: DataFrame | None = None, path: str | None = None, **options) -> str:
    """A folder with the messages' logs, appended in order of event_id and numbered by the log."""
    path = path or folder(s)
    rows = s.messages if rows is None else rows
    log.append(rows.select(*QUEUE, "event_id", F.col("ts_ms").alias("timestamp_ms"), "flags", "headers", "payload"), path, ["event_id"], **options)
    return path


def read(s: Source, path: str, **options) -> DataFrame:
    return s.spark.read.format("tidemark").options(path=path, **options).load()


def digested(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS[:-1], F.md5("payload").alias("payload_md5"))


def damaged(s: Source, path: str, at: int, change, ends: bool = False) -> None:
    """Change the bytes of each log's record ``at``; change(bytes of the segment, position) gives the new ones. A log that ``ends`` there has no segments behind it."""
    store = Store(path)
    for r in read(s, path).filter(F.col("offset") == at).select(*QUEUE, "segment_base", "file_pos").collect():
        file = log.segment_path(log.log_dir(store, "messages", r["topic"], r["part"]), r["segment_base"])
        store.put(file, change(store.read(file), r["file_pos"]))
        folder = log.log_dir(store, "messages", r["topic"], r["part"])
        for base in [b for b in log.bases(store, folder) if ends and b > r["segment_base"]]:
            for kind in ("log", "idx"):
                store.remove(log.segment_path(folder, base, kind))


def log_append_twice(s: Source) -> DataFrame:
    """Two appends of other rows to the same logs: nothing is lost and numbers go on."""
    half = s.messages.agg(F.floor(F.max("event_id") / 2)).first()[0] or 0
    path = stored(s, s.messages.filter(F.col("event_id") <= half))
    return digested(read(s, stored(s, s.messages.filter(F.col("event_id") > half), path)))


def log_append_again(s: Source) -> DataFrame:
    """The same commit brought twice: it counts once."""
    path = stored(s, commit_id="once")
    return digested(read(s, stored(s, path=path, commit_id="once")))


def log_scan_range(s: Source) -> DataFrame:
    return digested(read(s, stored(s, segmentBytes=4096, indexStride=512)).filter("offset >= 17 and offset < 120"))


def log_point_fetch(s: Source) -> DataFrame:
    return digested(read(s, stored(s, segmentBytes=4096, indexStride=512)).filter("topic = 'view' and part = 2 and offset = 7"))


def log_watermarks(s: Source) -> DataFrame:
    """Head, tail and last durable offset, from the files of logs in segments of 50 records."""
    return log.status(s.spark, stored(s, spread=False, segmentBytes=100, rollBatch=50)).select(*QUEUE, "head", "tail", "durable", "segments")


def log_resync(s: Source) -> DataFrame:
    """A damaged record in each log: the next good frame is found."""
    path = stored(s)
    damaged(s, path, 5, lambda buf, at: buf[: at + 40] + bytes([buf[at + 40] ^ 1]) + buf[at + 41 :])
    return digested(read(s, path))


def log_stop(s: Source) -> DataFrame:
    """A damaged record in each log: reading stops there."""
    path = stored(s)
    damaged(s, path, 5, lambda buf, at: buf[: at + 40] + bytes([buf[at + 40] ^ 1]) + buf[at + 41 :])
    return digested(read(s, path, corruption="stop"))


def log_torn_tail(s: Source) -> DataFrame:
    """Each log is torn within record 9; what is appended then goes on at 9."""
    path = stored(s)
    damaged(s, path, 9, lambda buf, at: buf[: at + 20], ends=True)
    again = s.messages.filter("off >= 9")
    return digested(read(s, stored(s, again, path)))


def log_cleanup(s: Source) -> DataFrame:
    """Logs in segments of 50 records, truncated before the middle of each: the heads that remain, and what is read."""
    path = stored(s, spread=False, segmentBytes=100, rollBatch=50)
    middles = s.messages.groupBy(*QUEUE).agg(F.floor(F.count("*") / 2).alias("acked_until"))
    heads = log.cleanup(middles, path).select(*QUEUE, "head")
    return heads.join(read(s, path).groupBy(*QUEUE).agg(F.min("offset").alias("first_read"), F.count("*").alias("n_read")), QUEUE)


def event_log_replay(s: Source) -> DataFrame:
    """Queue state from events that went through the event log's bytes."""
    path, ev = folder(s), cut(s.events)
    append_events(ev.withColumn("at", F.col("seq")), path, ["at"])
    return replay.queue_state(cut(read(s, path, decodeEvents="true").drop("blob")))


def snapshot_recovery(s: Source) -> DataFrame:
    """State from the latest of two snapshots and the events after it."""
    path, ev = folder(s), cut(s.events)
    top = ev.agg(F.max("seq")).first()[0] or 0
    for upto in (top // 3, top // 2):
        snapshots.take(ev.filter(F.col("seq") < upto), path, every=max(1, top // 50))
    return snapshots.recover(ev, path)


def dead_letter_routing(s: Source) -> DataFrame:
    routed = state.dead_letter_messages(s.messages, replay.settlements(s.events))
    return routed.select(*QUEUE, "source_off", "reason", F.md5("payload").alias("payload_md5"))


FUNCTIONS = (log_append_twice, log_append_again, log_scan_range, log_point_fetch, log_watermarks, log_resync, log_stop, log_torn_tail, log_cleanup, event_log_replay, snapshot_recovery, dead_letter_routing, queue_summary, ack_frontier, offset_state, offset_state_fold, is_acked_lookup, inflight_dump, inflight_count, next_expiry_hint, next_expiry_hint_global, list_expired, expired_top_k_per_queue, next_deliverable, ready_semi_join, ready_messages, fetch_available_anti_join, retry_counts, dead_letters, retry_exhausted, settlement_reasons, out_of_order_acks, ack_bitmap_sizes, offset_gaps, list_queues, list_topics, validate_violations, canonical_dump, safe_truncate_before, scan_from, fetch_by_offset, head_tail_watermarks, segment_list, segment_floor_lookup, segment_assignment, sparse_index_entries, index_seek, record_positions, record_bytes_len, retention_deletable_segments, retention_new_heads, offset_assignment, batch_linger_sessions, batch_flush_reasons, monotonic_clock, topic_validate, topic_error_class, path_encode, segment_file_names, durability_levels, codec_roundtrip, event_codec_roundtrip, crc32c_check, incremental_replay, incremental_replay_equals_full)


def _query(f):
    return lambda spark, sf_dir: f(Source(spark, sf_dir))


QUERIES = {f.__name__: _query(f) for f in FUNCTIONS}
