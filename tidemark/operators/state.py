"""Queries over offset_state and queue_state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.replay import BUCKET, OFFSET
from tidemark.schemas import QUEUE


def lookup(items: DataFrame, state: DataFrame, frontiers: DataFrame) -> DataFrame:
    """``items`` (topic, part, off) with acked, inflight, enqueued, retries; unknown queues and offsets have none."""
    known = items.join(state.select(*OFFSET, "settled", "inflight", "enqueued", "retries"), OFFSET, "left").join(frontiers.select(*QUEUE, "acked_until"), QUEUE, "left")
    acked = F.coalesce(F.col("off") < F.col("acked_until"), F.lit(False)) | F.coalesce("settled", F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return known.select(*items.columns, acked.alias("acked"), flag("inflight"), (acked | F.coalesce("inflight", F.lit(False))).alias("inflight_or_acked"), flag("enqueued"), "retries")


def lowest_unacked(queues: DataFrame, frontiers: DataFrame) -> DataFrame:
    """The frontier of each queue asked for; an unknown one has 0."""
    return queues.join(frontiers.select(*QUEUE, "acked_until"), QUEUE, "left").fillna({"acked_until": 0})


def inflight(state: DataFrame) -> DataFrame:
    return state.filter("inflight").select(*OFFSET, "deadline")


def inflight_count(queues: DataFrame, state: DataFrame) -> DataFrame:
    """Leases of each queue asked for, expired ones included; an unknown queue has 0."""
    counts = state.filter("inflight").groupBy(*QUEUE).agg(F.count("*").alias("n_inflight"))
    return queues.join(counts, QUEUE, "left").fillna({"n_inflight": 0})


def next_expiry(state: DataFrame, by: list[str]) -> DataFrame:
    return state.groupBy(*by).agg(F.min("deadline").alias("next_expiry"))


def expired(state: DataFrame, now: int, most: int) -> DataFrame:
    """Leases due by ``now``: by queue, then the earliest deadline, then the larger offset first."""
    due = state.filter(F.col("inflight") & (F.col("deadline") <= now)).select(*OFFSET, "deadline")
    return due.orderBy(*QUEUE, "deadline", F.desc("off")).limit(most)


def expired_per_queue(state: DataFrame, now: int, most: int) -> DataFrame:
    w = Window.partitionBy(*QUEUE).orderBy("deadline", F.desc("off"))
    due = state.filter(F.col("inflight") & (F.col("deadline") <= now)).withColumn("rank", F.row_number().over(w).cast("long"))
    return due.filter(F.col("rank") <= most).select(*OFFSET, "deadline", "rank")


def next_deliverable(asked: DataFrame, state: DataFrame, frontiers: DataFrame) -> DataFrame:
    """``asked`` (topic, part, start, upper) with the least offset in [start, upper) neither leased nor settled, else upper.

    Only offsets at or beyond the frontier are looked at. The busy offsets are numbered from the start; the
    answer is the end of their unbroken run, so no range of offsets is spelled out.
    """
    base = asked.join(frontiers.select(*QUEUE, "acked_until"), QUEUE, "left")
    base = base.withColumn("_from", F.greatest("start", F.coalesce("acked_until", F.lit(0))))
    busy = state.filter("settled or inflight").select(*OFFSET)
    held = base.join(busy, QUEUE).filter("off >= _from and off < upper").select(*QUEUE, "start", "upper", "_from", "off")
    rn = F.row_number().over(Window.partitionBy(*QUEUE, "start", "upper", F.floor(F.col("off") / BUCKET)).orderBy("off"))
    placed = held.withColumn("_b", F.floor(F.col("off") / BUCKET)).withColumn("_rn", rn)
    low = F.greatest(F.col("_from"), F.col("_b") * BUCKET)
    runs = placed.groupBy(*QUEUE, "start", "upper", "_from", "_b").agg(F.count_if(F.col("off") == low + F.col("_rn") - 1).alias("_n"))
    runs = runs.withColumn("_low", low).withColumn("_full", F.col("_low") + F.col("_n") == (F.col("_b") + 1) * BUCKET)
    w = Window.partitionBy(*QUEUE, "start", "upper").orderBy("_b")
    first = F.floor(F.col("_from") / BUCKET)
    before = F.coalesce(F.sum(F.col("_full").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = runs.withColumn("_end", F.when(before == F.col("_b") - first, F.col("_low") + F.col("_n"))).groupBy(*QUEUE, "start", "upper").agg(F.max("_end").alias("_end"))
    out = base.join(ends, [*QUEUE, "start", "upper"], "left")
    return out.select(*asked.columns, F.least("upper", F.greatest(F.coalesce("_end", "_from"), "_from")).alias("next_off"))


def dead_letter_messages(msgs: DataFrame, settled: DataFrame, suffix: str = ".dead") -> DataFrame:
    """The messages that were settled without an ack, under the topic that collects them: with reason and source_off, to be appended there."""
    gone = settled.filter("reason <> 'ack'").select(*OFFSET, "reason")
    return msgs.join(gone, OFFSET).withColumnRenamed("off", "source_off").withColumn("topic", F.concat("topic", F.lit(suffix)))


def keep_enqueued(items: DataFrame, state: DataFrame) -> DataFrame:
    """The items whose offset is enqueued; of an unknown queue none stay."""
    return items.join(state.filter("enqueued").select(*OFFSET), OFFSET, "left_semi")


def available(msgs: DataFrame, state: DataFrame, start: int, most: int) -> DataFrame:
    """Of each queue the first ``most`` messages from ``start`` that are neither settled nor leased."""
    free = msgs.filter(F.col("off") >= start).join(state.filter("settled or inflight").select(*OFFSET), OFFSET, "left_anti")
    w = Window.partitionBy(*QUEUE).orderBy("off")
    return free.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most).drop("_rn")


def out_of_order(state: DataFrame, frontiers: DataFrame) -> DataFrame:
    """Settled offsets beyond their queue's frontier: what a bitmap over the window would hold."""
    return state.filter("settled").join(frontiers, QUEUE).filter("off > acked_until").select(*OFFSET, "acked_until")


def ack_bitmap(state: DataFrame, frontiers: DataFrame) -> DataFrame:
    """Bitmaps of the settled offsets beyond the frontier, a row for each 32,768 offsets from it."""
    far = out_of_order(state, frontiers).withColumn("_d", F.col("off") - F.col("acked_until"))
    return far.groupBy(*QUEUE, "acked_until", F.floor(F.col("_d") / 32_768).alias("bucket")).agg(F.bitmap_construct_agg((F.col("_d") % 32_768).cast("long")).alias("bits"))


def violations(state: DataFrame, frontiers: DataFrame) -> DataFrame:
    """Rows that a sound state can't have."""
    joined = state.join(frontiers.select(*QUEUE, "acked_until"), QUEUE, "left").fillna({"acked_until": 0})
    rule = F.when(F.col("inflight") & (F.col("off") < F.col("acked_until")), "lease below frontier").when(F.col("inflight") & F.col("settled"), "lease on settled offset").when(~F.col("settled") & (F.col("off") < F.col("acked_until")), "unsettled below frontier").when(F.col("settled") & (F.col("off") == F.col("acked_until")), "settled at frontier").when(F.col("inflight") != F.col("deadline").isNotNull(), "lease without deadline")
    return joined.withColumn("rule", rule).filter("rule is not null").select(*OFFSET, "rule")


def canonical(state: DataFrame, queues: DataFrame) -> DataFrame:
    """A deterministic image of each queue: frontier, settled beyond it, leases, enqueued. A row of arrays for a queue."""
    lease = F.array_sort(F.collect_list(F.when(F.col("inflight"), F.struct("off", "deadline"))))
    ready = F.array_sort(F.collect_list(F.when(F.col("enqueued"), F.struct("off", "retries"))))
    joined = state.join(queues.select(*QUEUE, "acked_until"), QUEUE)
    ahead = F.array_sort(F.collect_list(F.when(F.col("settled") & (F.col("off") > F.col("acked_until")), F.col("off"))))
    return joined.groupBy(*QUEUE, "acked_until").agg(ahead.alias("ahead"), lease.alias("inflight"), ready.alias("enqueued"))
