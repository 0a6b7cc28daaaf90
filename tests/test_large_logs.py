"""What large logs need: several segments a log, many small segments, frames and events by the batch, queues that are folded as a stream."""

import pyarrow as pa
import pytest

from tidemark.functions import codec
from tidemark.operators import fold, replay, snapshots
from tidemark.plans import queries
from tidemark.sources import log
from tidemark.sources.store import IO


@pytest.fixture
def in_ranges(spark):
    """Every append makes several segments of a log."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_stop_leaves_out_all_that_follows_in_a_log_of_several_segments(in_ranges, sf_dir):
    got = queries.QUERIES["log_stop"](in_ranges, sf_dir).select("topic", "part", "offset").collect()
    assert len(got) == len(set(got)) == 100 and {r["offset"] for r in got} == {0, 1, 2, 3, 4}


def test_a_torn_log_of_several_segments_goes_on_at_the_tear(in_ranges, sf_dir):
    got = queries.QUERIES["log_torn_tail"](in_ranges, sf_dir).select("topic", "part", "offset", "timestamp_ms").collect()
    want = queries.Source(in_ranges, sf_dir).messages.select("topic", "part", "off", "ts_ms").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def laid(path, n, **options):
    """A log of n records on disk, and its reader's options."""
    o = log.Options({"path": path, **options})
    x = log.Layout(o, o.store, log.log_dir(o.store, "messages", "t", 0), "t", 0, 1)
    x.add([codec.Record(i, i, i % 4, b"h" * (i % 3), b"p" * (i * 7 % 50)) for i in range(n)])
    x.close()
    return o


def read(options):
    x = log.LogReader(options)
    return [v for p in x.partitions() for b in x.read(p) for v in b.column("offset").to_pylist()]


def test_many_small_segments_are_forced_out_together_and_read_by_few_tasks(tmp_path):
    IO.clear()
    o = laid(str(tmp_path), 20_000, segmentBytes="100", rollBatch="50")
    assert IO["syncs"] <= 2
    assert log.bases(o.store, log.log_dir(o.store, "messages", "t", 0)) == list(range(0, 20_000, 50))
    IO.clear()
    assert read({"path": str(tmp_path)}) == list(range(20_000)) and IO["reads"] == 400
    assert len(log.LogReader({"path": str(tmp_path)}).partitions()) == 1
    assert len(log.LogReader({"path": str(tmp_path), "splitBytes": str(10 * log.OPEN)}).partitions()) > 40


def test_a_repaired_tear_is_read_on_and_a_gap_is_not(tmp_path):
    o = laid(str(tmp_path), 200, segmentBytes="100", rollBatch="50")
    first = log.segment_path(log.log_dir(o.store, "messages", "t", 0), 50)
    data = o.store.read(first)
    o.store.put(first, data + data[68:80])
    assert read({"path": str(tmp_path), "corruption": "stop"}) == list(range(200))
    o.store.put(first, data[:-10])
    assert read({"path": str(tmp_path), "corruption": "stop"}) == list(range(99))
    assert read({"path": str(tmp_path)}) == [i for i in range(200) if i != 99]


def test_frames_and_events_by_the_batch_are_those_made_one_by_one():
    records = [codec.Record(i, 5 * i, i % 7, b"h" * (i % 5), bytes([i % 256]) * (i * 37 % 2500)) for i in range(300)]
    buf, ends = codec.encode_columns(*map(list, zip(*((r.offset, r.timestamp_ms, r.flags, r.headers, r.payload) for r in records), strict=True)))
    assert b"".join(codec.encode_records(records)) == bytes(buf) and ends[-1] == len(buf)
    got = [x for s, n in codec.frames(bytes(buf), 0, batch=64) for x in zip(*[c.tolist() if hasattr(c, "tolist") else c for c in codec.columns(bytes(buf), s, n)], strict=True)]
    assert got == [(r.offset, r.timestamp_ms, r.flags, r.headers, r.payload) for r in records]
    rows = [(k, t, 3, None if k in ("ResetQueue", "Snapshot") else i, i % 3, 9 * i, i % 2 == 0, b"x" * i if k == "Snapshot" else None) for i in range(5) for k in codec.EVENT_CODES for t in ("a", "view", "é")]
    made = codec.encode_events(rows)
    assert made == [codec.encode_event(*r) for r in rows]
    back = codec.decode_events(made)
    assert [{c: v[i] for c, v in back.items()} for i in range(len(made))] == [codec.decode_event(m) for m in made]
    with pytest.raises(codec.CodecError, match="Truncated"):
        codec.decode_events([made[0], made[0][:-1]])


def test_a_queue_is_folded_as_a_stream(spark, sf_dir):
    events = queries.Source(spark, sf_dir).events.coalesce(1)
    got = fold.fold_state(events)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    a, b = (sorted(map(str, x.collect())) for x in (got, replay.offset_state(events)))
    assert a == b


def test_numbers_and_offsets_in_pages():
    n, o = fold.Numbers(), fold.Offsets()
    for x in (0, 5, 63, 64, 10**12):
        n[x] = None if x == 5 else x
        o.add(x)
    assert [n.get(x, 7) for x in (0, 1, 5, 64, 10**12)] == [0, 7, None, 64, 10**12] and 5 in n and 1 not in n
    assert n.pop(64) == 64 and 64 not in n and n.pop(64, 3) == 3 and n.pop(5, 1) is None
    o.remove(63)
    assert list(o) == [0, 5, 64, 10**12] and 63 not in o and 64 in o


def test_a_snapshot_replays_once(spark, sf_dir, tmp_path, monkeypatch):
    seen, whole = [], snapshots.cut
    monkeypatch.setattr(snapshots, "cut", lambda df: seen.append(df.columns) or whole(df))
    assert snapshots.take(queries.Source(spark, sf_dir).events, str(tmp_path), every=1) == 1
    assert any("settled" in columns for columns in seen)
