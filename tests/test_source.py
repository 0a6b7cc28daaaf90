import os
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.operators import replay
from tidemark.operators import events as event_rows_of
from tidemark.operators import scans, snapshots, state
from tidemark.sources import log
from tidemark.sources.store import IO, Conflict, LogError, Store, of_system
from tidemark.streaming import state as stream


@pytest.fixture(scope="module")
def source(spark):
    log.register(spark)
    return spark


def own(path, topic="click", part=0, kind="messages"):
    store = Store(path)
    return store, log.log_dir(store, kind, topic, part)


def rows(spark, n=2000, parts=3):
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, "a/b").otherwise("click").alias("topic"), (F.col("id") % parts).alias("part"), "id")
    from tidemark.operators.scans import assign_offsets

    placed = assign_offsets(df, ["id"]).withColumnRenamed("off", "offset")
    return placed.select("topic", "part", "offset", F.concat(F.lit("msg-"), "id").cast("binary").alias("payload"), F.lit(7).alias("flags"), (F.col("id") + 5).alias("timestamp_ms"), F.lit(b"h").alias("headers"))


def write(df, path, mode="append", **options):
    w = df.repartition("topic", "part").sortWithinPartitions("topic", "part", "offset").write.format("tidemark").option("path", path)
    for k, v in options.items():
        w = w.option(k, v)
    w.mode(mode).save()


def read(spark, path, **options):
    r = spark.read.format("tidemark").option("path", path)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


def test_what_is_written_is_read(source, tmp_path):
    path, df = str(tmp_path), rows(source)
    write(df, path, segmentBytes=4096, indexStride=1024)
    got = read(source, path, splitBytes=2048)
    cols = ["topic", "part", "offset", "payload", "flags", "timestamp_ms", "headers"]
    assert got.select(cols).exceptAll(df.select(cols)).count() == 0 and got.count() == 2000
    assert len(log.bases(*own(path, "a/b"))) > 2
    assert got.filter("topic = 'a/b' and part = 2 and offset = 100").count() == 1
    assert got.filter("topic = 'click' and part in (0, 1) and offset >= 50 and offset < 60").count() == 20
    assert got.filter("offset > 5 and offset <= 4").count() == 0
    assert read(source, path, includePayload="false").filter("payload is not null").count() == 0
    assert not os.path.exists(os.path.join(path, "tmp")) or not os.listdir(os.path.join(path, "tmp"))


def test_pushed_filters_prune_logs_and_segments(source, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    path = str(tmp_path)
    write(rows(source), path, segmentBytes=4096, indexStride=512)
    r = log.PushingReader({"path": path})
    everything = len(r.partitions())
    assert list(r.pushFilters([EqualTo(("topic",), "click"), EqualTo(("part",), 1), GreaterThanOrEqual(("offset",), 150), LessThan(("offset",), 160)])) == []
    few = r.partitions()
    assert 0 < len(few) <= 2 < everything and few[0].begin > codec.SEGMENT_HEAD


def test_append_reopen_and_overwrite(source, tmp_path):
    path, df = str(tmp_path), rows(source, 600, 1)
    write(df.filter("offset < 100"), path)
    write(df.filter("offset >= 100"), path)
    got = read(source, path).filter("topic = 'click'").orderBy("offset").collect()
    assert [r["offset"] for r in got] == list(range(300)) and {r["segment_base"] for r in got} == {0, 100}
    assert log.watermarks(*own(path)) == {"head": 0, "tail": 300, "durable": 299}
    write(df.filter("offset < 10"), path, "overwrite")
    assert read(source, path).count() == 20


def test_a_commit_brought_again_counts_once_and_other_rows_are_refused(source, tmp_path):
    path, df = str(tmp_path), rows(source, 100, 1)
    write(df, path, commitId="a")
    write(df, path, commitId="a")
    assert read(source, path).count() == 100
    for again in (df, df.filter("offset between 3 and 60"), df.withColumn("offset", F.col("offset") + 7)):
        with pytest.raises(Exception, match="Overlap"):
            write(again, path)
    assert read(source, path).count() == 100
    write(df.withColumn("offset", F.col("offset") + 50), path, commitId="b")
    assert read(source, path).select("topic", "offset").distinct().count() == 200


def test_rows_of_a_log_from_several_tasks_are_refused(source, tmp_path):
    df = rows(source, 400, 1).filter("topic = 'click'")
    for bad in (df.repartition(3, "offset"), df.coalesce(1).orderBy(F.desc("offset")).coalesce(1)):
        with pytest.raises(Exception, match="Overlap|OutOfOrder"):
            bad.write.format("tidemark").option("path", str(tmp_path)).mode("append").save()
    assert read(source, str(tmp_path)).count() == 0


def test_a_commit_that_broke_off_is_replaced(source, tmp_path, monkeypatch):
    path, df = str(tmp_path), rows(source, 200, 1)
    o = log.Options({"path": path, "segmentBytes": "2048", "commitId": "x"})
    made = []
    for topic in ("a/b", "click"):
        got = [r for r in df.filter(F.col("topic") == topic).orderBy("offset").collect()]
        x = log.Layout(o, o.store, str(tmp_path / "tmp" / topic.replace("/", "")), topic, 0, 1)
        x.add([codec.Record(r["offset"], 1, 0, b"", bytes(r["payload"])) for r in got])
        made.append(x.close())
    moved = Store.move

    def breaks(self, old, new):
        if "click" in new and new.endswith(f"{made[1][3][1]:020d}.log"):
            raise OSError("gone")
        moved(self, old, new)

    monkeypatch.setattr(Store, "move", breaks)
    with pytest.raises(OSError):
        log.publish(o, o.store, made, "x", 0)
    monkeypatch.setattr(Store, "move", moved)
    assert not log.known_commit(*own(path), "x")["done"]
    write(df, path, commitId="x", segmentBytes=2048)
    got = read(source, path).select("topic", "offset", "payload")
    assert got.exceptAll(df.select("topic", "offset", "payload")).count() == 0 and got.count() == 200


def test_append_numbers_from_the_end(source, tmp_path):
    path = str(tmp_path)
    df = rows(source, 300, 1).drop("offset").withColumn("at", F.col("timestamp_ms"))
    first = log.append(df, path, ["at"], commit_id="one")
    assert sorted(map(tuple, first.collect())) == [("a/b", 0, 0, 150, 150), ("click", 0, 0, 150, 150)]
    assert sorted(map(tuple, log.append(df, path, ["at"], commit_id="one").collect())) == sorted(map(tuple, first.collect()))
    second = log.append(df.filter("topic = 'click'"), path, ["at"])
    assert [tuple(r) for r in second.collect()] == [("click", 0, 150, 300, 150)]
    got = [(r["offset"], bytes(r["payload"])) for r in read(source, path, topic="click", part="0").orderBy("offset").collect()]
    assert [o for o, _ in got] == list(range(300)) and [p for _, p in got[:150]] == [p for _, p in got[150:]] == [f"msg-{i}".encode() for i in range(1, 300, 2)]
    assert {(r[0], r[2]) for r in log.ends(source, path).collect()} == {("a/b", 150), ("click", 300)}


def test_a_log_with_most_of_the_rows_is_written_by_many_tasks(source, tmp_path):
    path = str(tmp_path)
    df = source.range(6000).select(F.when(F.col("id") % 10 == 0, "small").otherwise("big").alias("topic"), F.lit(0).cast("long").alias("part"), F.col("id").cast("string").cast("binary").alias("payload"), (F.col("id") * 7919 % 6007).alias("at"))
    source.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(tuple(r) for r in log.append(df, path, ["at"]).collect()) == [("big", 0, 0, 5400, 5400), ("small", 0, 0, 600, 600)]
        assert len(log.bases(*own(path, "big"))) > 1
        log.append(df, path, ["at"])
    finally:
        source.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = [(r["offset"], int(bytes(r["payload"]))) for r in read(source, path, topic="big", part="0").orderBy("offset").collect()]
    want = [r["id"] for r in df.filter("topic = 'big'").select(F.decode("payload", "utf-8").cast("long").alias("id"), "at").orderBy("at").collect()]
    assert [o for o, _ in got] == list(range(10_800)) and [i for _, i in got] == want * 2
    assert read(source, path).filter("topic = 'big' and offset = 5399").count() == 1


def test_whole_batches_stay_in_a_segment(source, tmp_path):
    write(rows(source, 600, 1), str(tmp_path), segmentBytes=1500, rollBatch=7)
    found = log.bases(*own(str(tmp_path)))
    assert len(found) > 3 and all(b % 7 == 0 for b in found)
    assert read(source, str(tmp_path)).count() == 600


def test_reading_works_with_default_settings(spark, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        spark.dataSource.register(log.LogDataSource)
        write(rows(spark, 50, 1), str(tmp_path))
        assert read(spark, str(tmp_path)).filter("offset < 5").count() == 10
    finally:
        log.register(spark)


def test_a_point_fetch_reads_little(source, tmp_path):
    df = source.range(50_000).select(F.lit("t").alias("topic"), F.lit(0).cast("long").alias("part"), F.col("id").alias("offset"), F.lpad(F.col("id").cast("string"), 200, "x").cast("binary").alias("payload"))
    write(df, str(tmp_path), segmentBytes=16 << 20, indexStride=16_384)
    whole = sum(size for _, size in log.segments(*own(str(tmp_path), "t")))
    x = log.PushingReader({"path": str(tmp_path)})
    x._within(33_333, 33_334)
    IO.clear()
    got = [b.column("payload").to_pylist() for p in x.partitions() for b in x.read(p)]
    assert got == [["x" * 195 + "33333"] * 0 + [b"x" * 195 + b"33333"]] and IO["bytes_read"] < 40_000 < whole / 200
    full = log.LogReader({"path": str(tmp_path), "splitBytes": "1000000"})
    IO.clear()
    assert len(full.partitions()) >= 12 and IO["reads"] == 0
    assert sum(b.num_rows for p in full.partitions() for b in full.read(p)) == 50_000 and IO["bytes_read"] < 1.1 * whole


def test_overwrite_keeps_the_old_log_if_it_fails(source, tmp_path):
    path, df = str(tmp_path), rows(source, 100, 1)
    write(df, path)
    with pytest.raises(Exception, match="Overlap"):
        df.repartition(3, "offset").write.format("tidemark").option("path", path).mode("overwrite").save()
    assert read(source, path).count() == 100


def test_a_second_writer_is_held_off(tmp_path):
    store = Store(str(tmp_path))
    with store.lock(store.at("l"), 60):
        with pytest.raises(Conflict), store.lock(store.at("l"), 60):
            pass
        os.utime(store.at("l"), (1, 1))
        with store.lock(store.at("l"), 60):
            pass
        open(store.at("l"), "w").close()
    assert not store.exists(store.at("l")) and of_system(OSError(28, "full")).reason == "OutOfSpace" and of_system(FileNotFoundError(2, "x")).reason == "DeviceGone"


def test_index_entries_must_rise():
    w = codec.IndexWriter(10, 1)
    w.add(12, 100)
    with pytest.raises(codec.CodecError, match="IndexOrder"):
        w.add(12, 200)
    head, missing = codec.decode_header(codec.encode_records([codec.Record(5, 6, 7, b"ab", b"cde")])[0][:38])
    assert (head["offset"], head["payload_len"], missing) == (5, 3, 3)


def test_cleanup_truncates_every_queue_before_its_frontier(source, tmp_path):
    path = str(tmp_path)
    write(rows(source, 2000, 2), path, segmentBytes=4096)
    frontiers = source.createDataFrame([("a/b", 0, 300), ("click", 1, 10**9), ("none", 0, 5)], "topic string, part int, acked_until long")
    heads = {(r["topic"], r["part"]): r["head"] for r in log.cleanup(frontiers, path).collect()}
    assert 0 < heads["a/b", 0] <= 300 and heads["click", 1] == log.bases(*own(path, "click", 1))[-1] and heads["none", 0] == 0
    assert read(source, path).groupBy("topic", "part").agg(F.min("offset").alias("m")).filter("topic = 'a/b'").first()["m"] == heads["a/b", 0]


def test_torn_tail_and_corruption(source, tmp_path):
    path = str(tmp_path)
    write(rows(source, 4000, 1), path)
    file = log.segment_path(own(path)[1], 0)
    data = open(file, "rb").read()
    open(file, "wb").write(data[:-17])
    click = lambda **o: read(source, path, topic="click", part="0", **o)
    assert click(corruption="stop").count() == 1999 == click().count()
    assert log.watermarks(*own(path))["tail"] == 1999
    broken = bytearray(data)
    broken[len(data) // 2] ^= 1
    open(file, "wb").write(bytes(broken))
    assert click().count() == 1999 and click(corruption="stop").count() < 1999
    with pytest.raises(Exception, match="CrcMismatch|BadMagic|Truncated|BadVersion"):
        click(corruption="fail").count()
    assert open(file, "rb").read() == bytes(broken)


def test_point_lookups(source, tmp_path):
    path = str(tmp_path)
    df = source.range(20_000).select(F.lit("t").alias("topic"), F.lit(0).cast("long").alias("part"), F.col("id").alias("offset"), F.col("id").cast("string").cast("binary").alias("payload"))
    write(df, path, segmentBytes=200_000, indexStride=4096)
    r = random.Random(1)
    reader_rows = {}
    for off in [r.randrange(20_000) for _ in range(100)]:
        x = log.PushingReader({"path": path})
        x._within(off, off + 1)
        for p in x.partitions():
            for batch in x.read(p):
                reader_rows[off] = batch.column("payload").to_pylist()
        assert reader_rows[off] == [str(off).encode()]


def test_truncation_keeps_the_active_segment(source, tmp_path):
    path = str(tmp_path)
    write(rows(source, 2000, 1), path, segmentBytes=8192)
    found = log.bases(*own(path))
    assert log.truncate_before(path, "messages", "click", 0, found[1] - 1) == 0
    assert log.truncate_before(path, "messages", "click", 0, found[2]) == found[2]
    assert log.truncate_before(path, "messages", "click", 0, 10**9) == found[-1]
    assert read(source, path, topic="click", part="0").agg(F.min("offset"), F.max("offset")).first() == (found[-1], 999)


def test_discovery_and_options(source, tmp_path):
    os.makedirs(tmp_path / "messages" / "t" / "xx")
    with pytest.raises(LogError):
        log.logs(Store(str(tmp_path)), "messages")
    assert log.logs(Store(str(tmp_path)), "events") == []
    for bad in ({}, {"path": "x", "corruption": "maybe"}):
        with pytest.raises(ValueError):
            log.Options(bad)
    with pytest.raises(codec.CodecError):
        codec.check_segment(codec.SEGMENT_MAGIC + struct.pack(">H", 9) + bytes(58))


def event_rows(spark, sf_dir):
    from tidemark.plans import derive

    return derive.queue_events(derive.messages(spark, sf_dir))


def test_events_through_the_log(source, sf_dir, tmp_path):
    ev = event_rows(source, sf_dir)
    encode = F.udf(lambda k, t, p, o, r, d, q: codec.encode_event(k, t, p, o, r, d, q), "binary")
    framed = ev.select("topic", "part", F.col("seq").alias("offset"), encode("event_type", "topic", "part", "off", "retries", "deadline", "requeue").alias("payload"))
    write(framed, str(tmp_path), kind="events")
    back = read(source, str(tmp_path), decodeEvents="true")
    cols = ["topic", "part", "seq", "event_type", "off", "retries", "deadline", "requeue"]
    assert back.select(cols).exceptAll(ev.select(cols)).count() == 0 and back.count() == ev.count()
    assert back.filter("seq < 3 and topic = 'click'").count() == 12


def test_streaming_read_and_state(source, sf_dir, tmp_path):
    ev = event_rows(source, sf_dir).cache()
    encode = F.udf(lambda k, t, p, o, r, d, q: codec.encode_event(k, t, p, o, r, d, q), "binary")
    framed = ev.select("topic", "part", F.col("seq").alias("offset"), encode("event_type", "topic", "part", "off", "retries", "deadline", "requeue").alias("payload"))
    path = str(tmp_path / "log")
    write(framed, path, kind="events")
    events = source.readStream.format("tidemark").option("path", path).option("decodeEvents", "true").option("maxRecordsPerBatch", 60).load()
    seen = []

    def keep(df, batch):
        seen.extend((batch, *r) for r in df.collect())

    q = stream.queue_state_stream(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert len({r[0] for r in seen}) >= 3
    last = {(r[1], r[2]): r[3:] for r in sorted(seen, key=lambda r: r[0])}
    want = {(r["topic"], r["part"]): tuple(r)[2:] for r in replay.queue_state(ev).collect()}
    assert last == want


def test_streaming_write(source, tmp_path):
    df = rows(source, 300, 1).filter("topic = 'click'")
    staged = str(tmp_path / "in")
    df.write.parquet(staged)
    out = str(tmp_path / "log")
    q = source.readStream.schema(df.schema).parquet(staged).writeStream.format("tidemark").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert read(source, out).count() == 150


def test_a_stream_that_brings_a_batch_again_writes_it_once(source, tmp_path):
    out, commits = str(tmp_path / "log"), tmp_path / "c" / "commits"

    def run(n):
        new = source.range(n * 10, n * 10 + 10).select(F.lit("t").alias("topic"), F.lit(0).cast("long").alias("part"), F.col("id").alias("offset"), F.lit(b"x").alias("payload"))
        new.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        again()

    def again():
        df = source.readStream.schema("topic string, part long, offset long, payload binary").parquet(str(tmp_path / "in"))
        df.writeStream.format("tidemark").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)

    run(0)
    run(1)
    for f in ("1", ".1.crc"):  # as if the driver had been lost between its commit and Spark's
        os.remove(commits / f)
    again()
    run(2)
    assert sorted(r["offset"] for r in read(source, out).collect()) == list(range(30))


def test_publish_goes_on_where_the_logs_end(source, tmp_path):
    path = str(tmp_path)
    msgs = lambda a, b: source.range(a, b).select(F.lit("t").alias("topic"), (F.col("id") % 2).alias("part"), F.col("id").cast("string").cast("binary").alias("payload"), F.col("id").alias("arrival"))
    stream.publish(msgs(0, 50), path, commit_id="q-0")
    second = stream.publish(msgs(50, 80), path, commit_id="q-1")
    assert sorted(r["offset"] for r in second.filter("part = 0").collect()) == list(range(25, 40))
    again = stream.publish(msgs(50, 80), path, commit_id="q-1")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, second.collect()))
    third = stream.publish(msgs(80, 84), path)
    assert sorted(r["offset"] for r in third.collect()) == [40, 40, 41, 41]
    events = read(source, path, decodeEvents="true")
    assert replay.queue_state(events).agg(F.sum("n_enqueued")).first()[0] == 84
    got = read(source, path).orderBy("part", "offset").collect()
    assert [int(bytes(r["payload"])) for r in got] == [*range(0, 84, 2), *range(1, 84, 2)]


def test_publish_repairs_a_batch_without_its_events(source, tmp_path):
    path = str(tmp_path)
    msgs = source.range(20).select(F.lit("t").alias("topic"), F.lit(0).cast("long").alias("part"), F.col("id").cast("string").cast("binary").alias("payload"), F.col("id").alias("arrival"))
    log.append(scans.assign_offsets(msgs, ["arrival"]).withColumnRenamed("off", "offset").select("topic", "part", "offset", "payload"), path, commit_id="q-7")
    stream.publish(msgs, path, commit_id="q-7")
    assert read(source, path).count() == 20 and replay.queue_state(read(source, path, decodeEvents="true")).first()["n_enqueued"] == 20


def test_events_are_appended_by_kind(source, tmp_path):
    path = str(tmp_path)
    items = source.range(10).select(F.lit("t").alias("topic"), F.lit(0).cast("long").alias("part"), F.col("id").alias("off"), F.col("id").alias("at"))
    e = event_rows_of
    kinds = (e.enqueue(items), e.mark_inflight(items, F.col("off") + 100), e.ack(items.filter("off < 4")), e.nack(items.filter("off = 5")), e.nack(items.filter("off = 6"), False), e.dead_letter(items.filter("off = 7")), e.clear_inflight(items.filter("off = 8")))
    for n, k in enumerate(kinds):
        upto = e.append_events(k, path, ["at"], commit_id=f"c{n}").first()["next_offset"]
    assert upto == 10 + 10 + 4 + 4
    r = replay.queue_state(read(source, path, decodeEvents="true")).first()
    assert (r["acked_until"], r["n_settled"], r["n_inflight"], r["n_enqueued"], r["applied_upto"]) == (4, 6, 2, 1, 28)
    e.append_events(e.reset(items.select("topic", "part").distinct().withColumn("at", F.lit(0))), path, ["at"])
    assert replay.queue_state(read(source, path, decodeEvents="true")).first()["n_settled"] == 0


def test_snapshots_are_taken_when_due_and_recovered(source, sf_dir, tmp_path):
    ev, root = event_rows(source, sf_dir).cache(), str(tmp_path / "snap")
    half = ev.filter("seq < 60")
    want = {tuple(r) for r in replay.offset_state(ev).collect()}
    assert {tuple(r) for r in snapshots.recover(ev, root).collect()} == want
    assert snapshots.take(half, root, every=10_000) is None and snapshots.latest(source, root) is None
    assert snapshots.take(half, root, every=50) == 1 and snapshots.take(half, root, every=50) is None
    assert snapshots.latest(source, root).agg(F.max("upto")).first()[0] == 60
    assert {tuple(r) for r in snapshots.recover(ev.filter("seq >= 60"), root).collect()} == want
    assert snapshots.take(ev, root, every=50, keep=1) == 2 and snapshots.versions(root) == [2]
    assert {tuple(r) for r in snapshots.recover(ev.filter("seq < 0"), root).collect()} == want


def test_a_stream_that_begins_with_a_snapshot_ends_like_a_full_replay(source, sf_dir, tmp_path):
    ev, path = event_rows(source, sf_dir).cache(), str(tmp_path / "log")
    write(event_rows_of.encoded(ev).select("topic", "part", F.col("seq").alias("offset"), "payload"), path, kind="events")
    snap = replay.snapshot(ev, 70)
    later = source.readStream.format("tidemark").option("path", path).option("decodeEvents", "true").option("maxRecordsPerBatch", 50).load()
    seen = []
    q = stream.queue_state_stream(later, snapshot=snap).writeStream.outputMode("update").foreachBatch(lambda df, batch: seen.extend((batch, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    last = {(r[1], r[2]): r[3:] for r in sorted(seen, key=lambda r: r[0])}
    want = {(r["topic"], r["part"]): tuple(r)[2:] for r in replay.queue_state(ev).collect()}
    assert {k: last[k] for k in want if k in last} == want


def test_leases_run_out_by_timers(source, tmp_path):
    path, e, seen = str(tmp_path / "log"), event_rows_of, []
    items = lambda *offs: source.createDataFrame([("t", 0, o, o) for o in offs], "topic string, part long, off long, at long")
    e.append_events(e.mark_inflight(items(3, 4), F.col("off")), path, ["at"])
    e.append_events(e.mark_inflight(items(5), F.lit(1 << 60)), path, ["at"])
    events = source.readStream.format("tidemark").option("path", path).option("decodeEvents", "true").load()
    q = stream.queue_state_stream(events, expire=True).writeStream.outputMode("update").foreachBatch(lambda df, batch: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()

    def wait(done):  # timers make batches without rows, so there is never nothing to do
        end = time.time() + 30
        while time.time() < end and not (seen and done(seen[-1])):
            time.sleep(0.3)

    try:
        wait(lambda r: r["n_inflight"] == 1)
        e.append_events(e.ack(items(0)), path, ["at"])
        wait(lambda r: r["acked_until"] == 1)
    finally:
        q.stop()
    last = seen[-1]
    assert (last["n_inflight"], last["min_deadline"], last["acked_until"], last["applied_upto"]) == (1, 1 << 60, 1, 4)


def test_dead_letters_are_routed_to_topics_of_their_own(source, sf_dir, tmp_path):
    from tidemark.plans import derive

    msgs = derive.messages(source, sf_dir)
    routed = state.dead_letter_messages(msgs, replay.settlements(derive.queue_events(msgs)))
    n = routed.count()
    log.append(routed.select("topic", "part", "payload", "source_off"), str(tmp_path), ["source_off"])
    assert n > 20 and read(source, str(tmp_path)).filter("topic like '%.dead'").count() == n
