"""Replay of queue events into state, with windows and aggregates only.

Without the bounded window of out-of-order settlements the offsets of a queue are independent, so the
state of an offset is a fold over its own few events; all windows here are partitioned by (topic, part, off)
and share one exchange, whatever the size of a queue. The join with the last resets has a row for each queue on its
other side; adaptive execution broadcasts that or splits a large queue. Only frontiers look across offsets, and they do so
in buckets of BUCKET offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schemas import MAX_RETRIES, QUEUE

OFFSET = [*QUEUE, "off"]
BUCKET = 65_536
CYCLE = MAX_RETRIES + 1


def since_reset(events: DataFrame) -> DataFrame:
    """Events with an offset that come after the last reset of their queue."""
    resets = events.filter("event_type = 'ResetQueue'").groupBy(*QUEUE).agg(F.max("seq").alias("_reset"))
    kept = events.filter("off is not null and event_type <> 'ResetQueue'").join(resets, QUEUE, "left")
    # dealt by offset from here on: the join's partitioning by queue would do for the windows, but puts a
    # queue with a large share of all events into one task
    return kept.filter("_reset is null or seq > _reset").drop("_reset").repartition(*OFFSET)


def after_settlement(value: Column, nacks: Column) -> Column:
    """Retries of a settled offset after so many further requeues: they count up, run out, and start again."""
    base = F.coalesce(value, F.lit(0))
    gone = F.greatest(F.lit(1), F.lit(CYCLE) - base)  # the nack that exhausts it
    rest = (nacks - gone) % CYCLE
    return F.when(nacks == 0, value).when(nacks < gone, base + nacks).when(rest > 0, rest)


def with_settlement(events: DataFrame) -> DataFrame:
    """Events with _base and _k of their run, whether they exhaust the retries, and the settlement's seq."""
    kind = F.col("event_type")
    requeues = (kind == "Nack") & F.col("requeue")
    # all windows have one order, so an offset's events are sorted once
    by_seq = Window.partitionBy(*OFFSET).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("_requeues", F.coalesce(requeues, F.lit(False))).withColumn("_k", F.count_if("_requeues").over(by_seq))
    begins = F.when(kind.isin("Enqueue", "MarkInflight"), F.struct(F.col("_k").alias("k"), F.when(kind == "Enqueue", F.col("retries")).alias("base")))
    rows = rows.withColumn("_run", F.last(begins, ignorenulls=True).over(by_seq))
    rows = rows.withColumn("_k", F.col("_k") - F.coalesce("_run.k", F.lit(0))).withColumn("_base", F.col("_run.base"))
    rows = rows.withColumn("_exhausts", F.col("_requeues") & (F.coalesce("_base", F.lit(0)) + F.col("_k") - 1 >= MAX_RETRIES))
    settles = kind.isin("Ack", "DeadLetter") | ((kind == "Nack") & ~F.col("_requeues")) | F.col("_exhausts")
    return rows.withColumn("_settles", settles).withColumn("_s", F.min(F.when(F.col("_settles"), F.col("seq"))).over(Window.partitionBy(*OFFSET)))


def offset_state(events: DataFrame) -> DataFrame:
    """A row for each offset that has an event since the last reset."""
    rows = with_settlement(since_reset(events))
    before = F.col("_s").isNull() | (F.col("seq") < F.col("_s"))
    lease = F.col("event_type").isin("MarkInflight", "ClearInflight") | F.col("_requeues")
    agg = rows.groupBy(*OFFSET).agg(
        F.max("_s").alias("_s"),
        F.max_by(F.when(lease, F.struct("event_type", "deadline")), F.when(lease, F.col("seq"))).alias("_lease"),
        F.max_by(F.when(before, F.struct("_base", "_k")), F.when(before, F.col("seq"))).alias("_last"),
        F.max(F.col("_exhausts") & (F.col("seq") == F.col("_s"))).alias("_out"),
        F.count_if(F.col("_requeues") & (F.col("seq") > F.col("_s"))).alias("_m"),
    )
    last = F.when(~F.coalesce("_out", F.lit(False)), F.when(F.col("_last._base").isNotNull(), F.col("_last._base") + F.col("_last._k")).when(F.col("_last._k") > 0, F.col("_last._k")))
    settled = F.col("_s").isNotNull()
    leased = ~settled & (F.col("_lease.event_type") == "MarkInflight")
    out = agg.withColumn("settled", settled).withColumn("inflight", F.coalesce(leased, F.lit(False)))
    out = out.withColumn("deadline", F.when(F.col("inflight"), F.col("_lease.deadline"))).withColumn("retries", F.when(settled, after_settlement(last, F.col("_m"))).otherwise(last).cast("long"))
    return out.select(*OFFSET, "settled", "inflight", "deadline", F.col("retries").isNotNull().alias("enqueued"), "retries")


def settlements(events: DataFrame) -> DataFrame:
    """topic, part, off, seq, reason of the event that settled each offset."""
    rows = with_settlement(since_reset(events)).filter("_settles and seq = _s")
    reason = F.when(F.col("event_type") == "Ack", "ack").when(F.col("event_type") == "DeadLetter", "dead_letter").when(F.col("_exhausts"), "retries_exhausted").otherwise("nack")
    return rows.select(*OFFSET, "seq", reason.alias("reason"))


def frontier(settled: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(topic, part, acked_until): the settled prefix of each queue with a settled offset.

    Offsets are numbered within buckets; a queue's prefix goes on through its full buckets. The window
    over a whole queue has a row for each bucket only.
    """
    rows = settled.select(*OFFSET).distinct().withColumn("_b", F.floor(F.col("off") / bucket))
    rn = F.row_number().over(Window.partitionBy(*QUEUE, "_b").orderBy("off")) - 1
    per_bucket = rows.withColumn("_hit", F.col("off") - F.col("_b") * bucket == rn).groupBy(*QUEUE, "_b").agg(F.count_if("_hit").alias("_n"))
    return reached(per_bucket, bucket).groupBy(*QUEUE).agg(F.coalesce(F.max("_r"), F.lit(0)).cast("long").alias("acked_until"))


def reached(per_bucket: DataFrame, bucket: int) -> DataFrame:
    """``per_bucket`` (_b, _n: the settled prefix within it) with _r, where the queue's prefix gets to if it reaches the bucket."""
    by_bucket = Window.partitionBy(*QUEUE).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum(F.when(F.col("_n") == bucket, 1).otherwise(0)).over(by_bucket), F.lit(0))
    return per_bucket.withColumn("_r", F.when(full == F.col("_b"), F.col("_b") * bucket + F.col("_n")))


def queue_state(events: DataFrame, state: DataFrame | None = None, bucket: int = BUCKET) -> DataFrame:
    """One row for each queue that has any event. The state is gone through once, for counts and frontier together."""
    state = offset_state(events) if state is None else state
    rows = state.withColumn("_b", F.floor(F.col("off") / bucket))
    rn = F.row_number().over(Window.partitionBy(*QUEUE, "_b", "settled").orderBy("off")) - 1
    rows = rows.withColumn("_hit", F.col("settled") & (F.col("off") - F.col("_b") * bucket == rn))
    counts = [F.count_if(c).alias(f"n_{c}") for c in ("settled", "inflight", "enqueued")]
    per_bucket = rows.groupBy(*QUEUE, "_b").agg(F.count_if("_hit").alias("_n"), *counts, F.min("deadline").alias("min_deadline"))
    total = [F.sum(f"n_{c}").alias(f"n_{c}") for c in ("settled", "inflight", "enqueued")]
    sums = reached(per_bucket, bucket).groupBy(*QUEUE).agg(F.coalesce(F.max("_r"), F.lit(0)).cast("long").alias("acked_until"), *total, F.min("min_deadline").alias("min_deadline"))
    upto = events.groupBy(*QUEUE).agg((F.max("seq") + 1).alias("applied_upto"))
    joined = upto.join(sums, QUEUE, "left").fillna({"acked_until": 0, "n_settled": 0, "n_inflight": 0, "n_enqueued": 0})
    return joined.select(*QUEUE, "acked_until", "n_settled", "n_inflight", "n_enqueued", "min_deadline", "applied_upto")


def snapshot(events: DataFrame, upto: DataFrame | int) -> DataFrame:
    """State after the events with seq < upto: offset_state with the column upto (exclusive).

    ``upto`` is a number for all queues, or a table (topic, part, upto).
    """
    cuts = events.select(*QUEUE).distinct().withColumn("upto", F.lit(upto).cast("long")) if isinstance(upto, int) else upto
    early = events.join(cuts, QUEUE).filter("seq < upto")
    return offset_state(early.drop("upto")).join(cuts, QUEUE)


def resume(snapshots: DataFrame, cuts: DataFrame, events: DataFrame) -> DataFrame:
    """offset_state of snapshots plus the events with seq >= their upto; nothing earlier is read.

    A snapshot row becomes pseudo events that lie before the rest: its enqueue, its settlement and what
    was re-queued after it, its lease.
    """
    at = lambda n, kind, **v: F.struct(F.lit(n).cast("long").alias("seq"), F.lit(kind).alias("event_type"), *[v.get(c, F.lit(None)).cast(k).alias(c) for c, k in (("retries", "long"), ("deadline", "long"), ("requeue", "boolean"))])
    s, q, lease = F.col("settled"), F.col("enqueued"), F.col("inflight")
    made = F.array(
        F.when(lease, at(-5, "MarkInflight", deadline=F.col("deadline"))),
        # an offset without retries that isn't settled is kept by an event that changes nothing
        F.when(~lease & ~q & ~s, at(-5, "ClearInflight")),
        F.when(q, at(-6, "Enqueue", retries=F.col("retries"))),
        F.when(s, at(-3, "Ack")),
    )
    # an enqueued offset with a lease: the lease first, then the enqueue that leaves it in place
    both = F.array(F.when(q & lease, at(-5, "MarkInflight", deadline=F.col("deadline"))), F.when(q & lease, at(-4, "Enqueue", retries=F.col("retries"))))
    pseudo = F.when(q & lease, both).otherwise(made)
    old = snapshots.select(*OFFSET, F.explode(F.filter(pseudo, lambda x: x.isNotNull())).alias("e")).select(*OFFSET, "e.*")
    new = events.join(cuts, QUEUE, "left").filter("upto is null or seq >= upto")
    return offset_state(old.unionByName(new.select(*OFFSET, "seq", "event_type", "retries", "deadline", "requeue")))
