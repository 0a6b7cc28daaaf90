import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import batching, fold, replay, scans, state
from tidemark.operators.fold import QueueFold
from tidemark.schemas import OFFSET_STATE, QUEUE_EVENTS

COLS = ["topic", "part", "seq", "event_type", "off", "retries", "deadline", "requeue", "blob"]


def history(seed, n, offs, reset=0.002):
    r = random.Random(seed)
    out = []
    for seq in range(n):
        kind = r.choices(["Enqueue", "MarkInflight", "Ack", "Nack", "DeadLetter", "ClearInflight"], [3, 3, 1.5, 6, 0.3, 1])[0]
        if r.random() < reset:
            kind = "ResetQueue"
        off = None if kind == "ResetQueue" else r.randrange(offs)
        out.append(("t", seed, seq, kind, off, r.choice([0, 0, 1, 4, 5, 6, 9]) if kind == "Enqueue" else None, r.randrange(1000) if kind == "MarkInflight" else None, r.random() < 0.85 if kind == "Nack" else None, None))
    return out


@pytest.fixture(scope="module")
def events(spark):
    rows = [x for s in range(12) for x in history(s, 600, 3 + 5 * s)]
    return spark.createDataFrame(rows, QUEUE_EVENTS).repartition(5).cache()


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_set_based_replay_equals_the_sequential_fold(events):
    assert same(replay.offset_state(events), fold.fold_state(events))


def test_frontier_equals_the_fold_for_any_bucket(spark):
    r = random.Random(9)
    rows, want = [], {}
    for p in range(30):
        offs = [o for o in range(200) if r.random() < (0.5, 0.95, 1.0)[p % 3]]
        rows += [("t", p, o) for o in offs]
        f = 0
        while f in set(offs):
            f += 1
        want[p] = f if offs else None
    df = spark.createDataFrame(rows, "topic string, part long, off long")
    for bucket in (1, 7, 64, 65_536):
        got = {x["part"]: x["acked_until"] for x in replay.frontier(df, bucket).collect()}
        assert got == {p: f for p, f in want.items() if f is not None}


@pytest.mark.parametrize("bucket", [3, 65_536])
def test_queue_state_counts(events, bucket):
    rows = {r["part"]: r for r in replay.queue_state(events, bucket=bucket).collect()}
    for p in range(12):
        q = QueueFold()
        for _, _, _, kind, off, retries, deadline, requeue, _ in history(p, 600, 3 + 5 * p):
            q.apply(kind, off, retries, deadline, requeue)
        r = rows[p]
        assert (r["acked_until"], r["n_settled"], r["n_inflight"], r["n_enqueued"], r["applied_upto"]) == (q.frontier, q.frontier + len(q.ahead), len(q.leases), len(q.retries), 600)
        assert r["min_deadline"] == min(q.leases.values(), default=None)


@pytest.mark.parametrize("upto", [0, 1, 150, 301, 599, 600])
def test_snapshot_and_later_events_equal_full_replay(events, upto):
    cuts = events.select("topic", "part").distinct().withColumn("upto", F.lit(upto).cast("long"))
    assert same(replay.resume(replay.snapshot(events, cuts), cuts, events), replay.offset_state(events))


def test_reverse_out_of_order_and_duplicate_acks():
    for order, want in (([2, 4, 0, 1, 3], [0, 0, 1, 3, 5]), ([2, 2, 0, 1, 1, 3], [0, 0, 1, 3, 3, 4])):
        q, seen = QueueFold(), []
        for o in order:
            q.apply("Ack", o)
            seen.append(q.frontier)
        assert seen == want
    q = QueueFold()
    for o in reversed(range(1000)):
        q.apply("Ack", o)
    assert q.frontier == 1000 and not q.ahead


def test_window_forgets_far_settlements_only_with_the_option():
    for window, want in ((None, True), (8192, False)):
        q = QueueFold(window)
        q.apply("MarkInflight", 8192, deadline=5)
        q.apply("Ack", 8192)
        assert q.is_settled(8192) is want and not q.leases
        q.apply("Ack", 8191)
        assert q.is_settled(8191)


def test_retries_exhaust_after_five_and_start_again():
    q = QueueFold()
    seen = []
    for _ in range(9):
        q.apply("Nack", 3, requeue=True)
        seen.append((q.retries.get(3), q.is_settled(3)))
    assert seen[:6] == [(1, False), (2, False), (3, False), (4, False), (5, False), (None, True)] and seen[6] == (1, True)
    q.apply("Enqueue", 3, retries=0)
    assert q.retries[3] == 3
    with pytest.raises(ValueError):
        q.apply("Snapshot", 0)


def test_expiry_order_once_and_stale_deadlines():
    q = QueueFold()
    for off, deadline in ((1, 10), (1, 30), (2, 20), (3, 20)):
        q.apply("MarkInflight", off, deadline=deadline)
    assert q.pop_expired(15, 9) == [] and q.pop_expired(25, 9) == [(3, 20), (2, 20)]
    assert q.pop_expired(35, 9) == [(1, 30)] and q.pop_expired(99, 9) == []


def test_expired_rows_follow_the_same_order(spark):
    st = spark.createDataFrame([("t", 0, o, False, True, d, False, None) for o, d in ((1, 5), (2, 5), (3, 4), (4, 9))], OFFSET_STATE)
    assert [(r["off"], r["deadline"]) for r in state.expired(st, 5, 2).collect()] == [(3, 4), (2, 5)]


def test_next_deliverable_against_a_walk(spark):
    r = random.Random(3)
    rows, asked, want = [], [], {}
    for p in range(20):
        q = QueueFold()
        for o in range(60):
            kind = r.choices(["settled", "leased", "free"], [6, 3, 1])[0]
            if kind == "settled":
                q.apply("Ack", o)
            elif kind == "leased":
                q.apply("MarkInflight", o, deadline=1)
        rows += [("t", p, *x) for x in q.rows()]
        for start, upper in ((0, 60), (10, 60), (20, 25), (59, 60), (0, 0)):
            asked.append(("t", p, start, upper))
            want[p, start, upper] = q.next_deliverable(start, upper)
    st = spark.createDataFrame(rows, OFFSET_STATE)
    fr = replay.frontier(st.filter("settled"))
    for bucket in (65_536, 8):
        old, state.BUCKET = state.BUCKET, bucket
        try:
            got = state.next_deliverable(spark.createDataFrame(asked, "topic string, part long, start long, upper long"), st, fr).collect()
        finally:
            state.BUCKET = old
        assert {(r["part"], r["start"], r["upper"]): r["next_off"] for r in got} == want


def test_validate_finds_planted_faults(spark):
    bad = [("t", 0, 0, True, False, None, False, None), ("t", 0, 1, False, True, 5, False, None), ("t", 0, 2, True, True, None, False, None)]
    st = spark.createDataFrame(bad, OFFSET_STATE)
    fr = spark.createDataFrame([("t", 0, 2)], "topic string, part long, acked_until long")
    assert {(r["off"], r["rule"]) for r in state.violations(st, fr).collect()} == {(1, "lease below frontier"), (2, "lease on settled offset")}


def test_empty_events(spark):
    none = spark.createDataFrame([], QUEUE_EVENTS)
    assert replay.queue_state(none).count() == 0 and fold.fold_state(none).count() == 0


def test_batcher_schedules():
    b = batching.Batcher(3, 100, 1000, 10)
    assert b.push(0, "a", 1, 1) == [] and b.push(9, "b", 1, 1) == []
    assert b.push(19, "c", 1, 1) == [("Timeout", ["a", "b"])]  # exactly linger after the last
    assert b.push(20, "d", 1, 1) == [] and b.push(21, "e", 1, 1) == [("MaxItems", ["c", "d", "e"])]
    assert b.push(22, "f", 1, 1) == [] and b.push(40, "g", 100, 1) == [("Timeout", ["f"]), ("MaxRecords", ["g"])]
    assert b.push(41, "h", 1, 1000) == [("MaxBytes", ["h"])]
    zero = batching.Batcher(9, 100, 1000, 0)
    assert zero.push(0, "a", 1, 1) == [] and zero.push(0, "b", 1, 1) == [("Timeout", ["a"])]


def test_flushes_lose_nothing(spark):
    r = random.Random(5)
    clock, rows = 0, []
    for i in range(1000):
        clock += r.choice([0, 1, 5, 20])
        rows.append(("t", 0, i, clock, r.randrange(1, 100)))
    df = spark.createDataFrame(rows, "topic string, part long, off long, ts_ms long, size long")
    got = batching.flushes(df, ["topic", "part"], "ts_ms", "off", "size", 8, 100, 300, 15).orderBy("batch").collect()
    assert sum(g["n"] for g in got) == 1000 and sum(g["bytes"] for g in got) == sum(x[4] for x in rows)
    assert {g["flush_reason"] for g in got} >= {"Timeout", "MaxItems", "MaxBytes"} and max(g["n"] for g in got) <= 8


def test_sessions_part_at_exactly_the_linger(spark):
    df = spark.createDataFrame([("t", i, c) for i, c in enumerate([0, 9, 19, 20, 31])], "topic string, off long, ts_ms long")
    got = batching.linger_sessions(df, ["topic"], "ts_ms", ["off"], 10).orderBy("session").collect()
    assert [(g["n"], g["first_ms"], g["last_ms"]) for g in got] == [(2, 0, 9), (2, 19, 20), (1, 31, 31)]


def test_gaps_across_buckets(spark):
    old, scans.BUCKET = scans.BUCKET, 10
    try:
        df = spark.createDataFrame([("t", 0, o) for o in (3, 4, 7, 9, 10, 41)], "topic string, part long, off long")
        got = scans.gaps(df).orderBy("gap_from").collect()
    finally:
        scans.BUCKET = old
    assert [(g["gap_from"], g["gap_to"]) for g in got] == [(5, 6), (8, 8), (11, 40)]


def test_layout_keeps_batches_whole(spark):
    df = spark.createDataFrame([("t", 0, o, bytearray(b""), bytearray(b"x" * 64)) for o in range(40)], "topic string, part long, off long, headers binary, payload binary")
    got = scans.layout(df, 1068, 250, 5).orderBy("off").collect()
    assert [g["segment_base"] for g in got] == [o // 10 * 10 for o in range(40)]
    assert [g["file_pos"] for g in got[:3]] == [68, 168, 268] and [g["off"] for g in got if g["indexed"]][:3] == [3, 6, 9]


def test_linger_adapts_to_the_batches():
    assert [batching.adapted_linger(5, n, 1 << 20, 6, p) for n, p in ((1 << 19, False), (600_000, True), (70_000, False), (60_000, False), (60_000, True))] == [6, 6, 5, 4, 5]
    assert batching.adapted_linger(6, 1 << 20, 1 << 20, 6, False) == 6 and batching.adapted_linger(0, 1, 1 << 20, 6, False) == 0


def test_ordered_operators_do_not_depend_on_the_parts(spark):
    r = random.Random(3)
    rows = [("t", p, o, r.randrange(1000)) for p in range(3) for o in range(400)]
    df = spark.createDataFrame(rows, "topic string, part long, off long, clock long")
    now, sessions = {}, {}
    for p in range(3):
        most, last, k = 0, None, 0
        for _, _, o, c in [x for x in rows if x[1] == p]:
            most = max(most, c)
            now[p, o] = most
            k += last is None or c - last >= 700
            last = c
            n, low, high = sessions.get((p, k), (0, c, c))
            sessions[p, k] = (n + 1, min(low, c), max(high, c))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert {(x["part"], x["off"]): x["now"] for x in scans.monotonic(df, "clock", ["topic", "part"], ["off"]).collect()} == now
        assert {(x["part"], x["session"]): (x["n"], x["first_ms"], x["last_ms"]) for x in batching.linger_sessions(df, ["topic", "part"], "clock", ["off"], 700).collect()} == sessions
        assert {(x["part"], x["off"]) for x in scans.assign_offsets(df.drop("off").withColumn("at", F.col("clock")), ["at"]).collect()} == set(now)
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_clock_in_milliseconds(spark):
    from tidemark.functions import scalars

    got = spark.sql("select timestamp'2024-01-01 00:00:00.123Z' as a, timestamp'1950-01-01 00:00:00Z' as b").select(scalars.unix_millis(F.col("a")), scalars.unix_millis(F.col("b")), scalars.unix_millis()).first()
    assert got[:2] == (1704067200123, 0) and got[2] > 1704067200123


def test_a_double_flush_loses_nothing():
    b = batching.Batcher(10, 10, 5, 3)
    assert b.deadline() is None and b.remaining(0) is None
    got = list(batching.driven(b, [(0, "a", 1, 1), (10, "b", 1, 9), (11, "c", 1, 1)]))
    assert got == [("Timeout", ["a"]), ("MaxBytes", ["b"]), ("Shutdown", ["c"])]
    b.push(20, "d", 1, 1)
    assert b.deadline() == 23 and b.remaining(21) == 2 and b.remaining(30) == 0
