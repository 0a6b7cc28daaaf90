"""Scans, watermarks, gaps, segments and retention over log records (topic, part, off, ...)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.replay import BUCKET
from tidemark.schemas import QUEUE

SEGMENT_HEAD = 68
SENT_PARTS = 200_000


def fetch(log: DataFrame, topic: str, part: int, off: int) -> DataFrame:
    return log.filter((F.col("topic") == topic) & (F.col("part") == part) & (F.col("off") == off))


def scan_from(log: DataFrame, topic: str, part: int, start: int, most: int) -> DataFrame:
    """Up to ``most`` records from ``start`` in order; past the end there are fewer or none."""
    own = log.filter((F.col("topic") == topic) & (F.col("part") == part) & (F.col("off") >= start))
    return own.orderBy("off").limit(most)


def watermarks(log: DataFrame) -> DataFrame:
    """head (first offset), tail (one past the last), durable (the last; null for an empty log), n_records."""
    return log.groupBy(*QUEUE).agg(F.min("off").alias("head"), (F.max("off") + 1).alias("tail"), F.max("off").alias("durable"), F.count("*").alias("n_records"))


def gaps(log: DataFrame) -> DataFrame:
    """Ranges of offsets that are missing between a log's head and tail: gap_from, gap_to (inclusive).

    Neighbours are compared within buckets of offsets, and the buckets' edges with each other.
    """
    rows = log.select(*QUEUE, "off").withColumn("_b", F.floor(F.col("off") / BUCKET))
    inside = rows.withColumn("_prev", F.lag("off").over(Window.partitionBy(*QUEUE, "_b").orderBy("off")))
    edges = rows.groupBy(*QUEUE, "_b").agg(F.min("off").alias("off"), F.max("off").alias("_max"))
    edges = edges.withColumn("_prev", F.lag("_max").over(Window.partitionBy(*QUEUE).orderBy("_b")))
    both = inside.select(*QUEUE, "off", "_prev").unionByName(edges.select(*QUEUE, "off", "_prev"))
    return both.filter("off > _prev + 1").select(*QUEUE, (F.col("_prev") + 1).alias("gap_from"), (F.col("off") - 1).alias("gap_to"))


def segments(log: DataFrame) -> DataFrame:
    """base, next_base (null for the active segment), last_off, n_records of each segment (column segment_base)."""
    per = log.groupBy(*QUEUE, F.col("segment_base").alias("base")).agg(F.max("off").alias("last_off"), F.count("*").alias("n_records"))
    return per.withColumn("next_base", F.lead("base").over(Window.partitionBy(*QUEUE).orderBy("base")))


def segment_of(asked: DataFrame, segs: DataFrame) -> DataFrame:
    """``asked`` (topic, part, off) with the segment that holds or precedes each offset; null before the first."""
    rows = segs.select(*[F.col(c).alias(f"_{c}") for c in QUEUE], "base", "next_base")
    same = (F.col("topic") == F.col("_topic")) & (F.col("part") == F.col("_part"))
    # a segment's range is disjoint from the others', so a record meets one at most
    return asked.join(rows, same & (F.col("base") <= F.col("off")) & (F.col("next_base").isNull() | (F.col("off") < F.col("next_base"))), "left").select(*asked.columns, "base")


def deletable(segs: DataFrame, before: DataFrame) -> DataFrame:
    """Sealed segments whose last offset (the next base less one) lies before the cut-off; the active one never goes.

    ``before`` is (topic, part, before). new_head is the first base that stays.
    """
    joined = segs.join(before, QUEUE).filter("next_base is not null and next_base - 1 < before")
    return joined.select(*QUEUE, "base", "last_off", "n_records", "before")


def heads_after(segs: DataFrame, gone: DataFrame) -> DataFrame:
    return segs.join(gone, [*QUEUE, "base"], "left_anti").groupBy(*QUEUE).agg(F.min("base").alias("head"))


def sized(log: DataFrame) -> DataFrame:
    """``log`` (off, headers, payload, segment_base) with size and the byte position in its segment."""
    from tidemark.functions.scalars import record_size

    w = Window.partitionBy(*QUEUE, "segment_base").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("size", record_size(F.col("headers"), F.col("payload")))
    return rows.withColumn("file_pos", F.sum("size").over(w) - F.col("size") + SEGMENT_HEAD)


def layout(log: DataFrame, segment_max: int, stride: int, batch: int) -> DataFrame:
    """topic, part, off, segment_base, file_pos, indexed: where a writer would put each record.

    A new segment starts when a whole batch (``batch`` records in order) wouldn't fit; an index entry is due
    when ``stride`` bytes have passed since the last. Both depend on all that came before, so a log is folded in
    order by one task, which holds offsets and sizes only (16 bytes a record).
    """
    from tidemark.functions.scalars import record_size

    slim = log.select(*QUEUE, "off", record_size(F.col("headers"), F.col("payload")).alias("size"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("off")
        offs, sizes = pdf["off"].tolist(), pdf["size"].tolist()
        base, at, mark, rows = offs[0], SEGMENT_HEAD, SEGMENT_HEAD, []
        for i, (off, size) in enumerate(zip(offs, sizes, strict=True)):
            if i % batch == 0 and at + sum(sizes[i : i + batch]) > segment_max and at > SEGMENT_HEAD:
                base, at, mark = off, SEGMENT_HEAD, SEGMENT_HEAD
            indexed = at - mark >= stride
            mark = at if indexed else mark
            rows.append((off, base, at, indexed))
            at += size
        out = pd.DataFrame(rows, columns=["off", "segment_base", "file_pos", "indexed"])
        out.insert(0, "part", int(pdf["part"].iloc[0]))
        out.insert(0, "topic", pdf["topic"].iloc[0])
        return out

    return slim.groupBy(*QUEUE).applyInPandas(run, "topic string, part long, off long, segment_base long, file_pos long, indexed boolean")


def seek(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """The byte position to start reading at for each asked offset: the last index entry at or before it, else the head."""
    w = Window.partitionBy(*QUEUE, "segment_base").orderBy("off")
    rows = entries.withColumn("_until", F.lead("off").over(w)).select(F.col("topic").alias("_topic"), F.col("part").alias("_part"), F.col("segment_base").alias("_base"), F.col("off").alias("_at"), "_until", "file_pos")
    same = (F.col("topic") == F.col("_topic")) & (F.col("part") == F.col("_part")) & (F.col("segment_base") == F.col("_base"))
    near = asked.join(rows, same & (F.col("_at") <= F.col("off")) & (F.col("_until").isNull() | (F.col("off") < F.col("_until"))), "left")
    return near.select(*asked.columns, F.coalesce("file_pos", F.lit(SEGMENT_HEAD)).cast("long").alias("start_pos"))


def in_parts(rows: DataFrame, by: list[str], order: list[str], at: str | None = None) -> DataFrame:
    """``rows`` with _p: dealt by ranges of ``by`` and ``order``, so that a queue of any size is spread over tasks and its parts follow each other by _p.

    With ``at``, that column is a row's place in its partition. Checkpointed, as the ranges come from a sample and must not change between two looks at them.
    """
    from tidemark.sources.shared import cut

    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_p", F.spark_partition_id())
    # monotonically_increasing_id counts the rows of a partition in its lower 33 bits
    return cut(dealt if at is None else dealt.withColumn(at, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))


def assign_offsets(rows: DataFrame, order: list[str], next_offsets: DataFrame | None = None) -> DataFrame:
    """Dense offsets for new rows of each (topic, part) in ``order``, from ``next_offsets`` (topic, part, next_off) or 0."""
    return placed_offsets(rows, order, next_offsets)[0]


def placed_offsets(rows: DataFrame, order: list[str], next_offsets: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """assign_offsets, and whether the partitions of the result are ranges of (topic, part, off).

    A row's place in its sorted partition is its number; a part begins where the ones before it end, by their counts. A table
    with a row for each part is all that is joined, and it is sent to all as long as it has at most SENT_PARTS rows, so the rows stay where they are.
    """
    from tidemark.sources.shared import cut

    at, n, first, start, end = "_at", "_n", "_first", "_start", "_end"
    dealt = in_parts(rows, QUEUE, order, at)
    counts = dealt.groupBy(*QUEUE, "_p").agg(F.count("*").alias(n), F.min(at).alias(first))
    before = F.coalesce(F.sum(n).over(Window.partitionBy(*QUEUE).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*QUEUE, "_p", first, before.alias(start))
    if next_offsets is not None:
        starts = starts.join(next_offsets.select(*QUEUE, F.col("next_off").alias(end)), QUEUE, "left").withColumn(start, F.col(start) + F.coalesce(end, F.lit(0)))
    starts = cut(starts.select(*QUEUE, "_p", (F.col(start) - F.col(first)).alias(start)))
    few = starts.count() <= SENT_PARTS
    placed = dealt.join(F.broadcast(starts) if few else starts, [*QUEUE, "_p"])
    return placed.withColumn("off", (F.col(at) + F.col(start)).cast("long")).select(*rows.columns, "off"), few


def monotonic(rows: DataFrame, clock: str, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with now: the running maximum of clock readings in ``order``, never below zero. A part goes on from the most of those before it."""
    dealt = in_parts(rows, by, order)
    most = dealt.groupBy(*by, "_p").agg(F.max(clock).alias("_m"))
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = most.select(*by, "_p", F.max("_m").over(earlier).alias("_m"))
    here = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.withColumn("_own", F.max(clock).over(here)).join(starts, [*by, "_p"])
    return joined.select(*rows.columns, F.greatest("_own", "_m", F.lit(0).cast("long")).alias("now"))
