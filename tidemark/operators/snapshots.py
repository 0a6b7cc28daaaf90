"""Snapshots of replayed state as versions of a Parquet table, and recovery from the latest one.

A version is complete once its last file says so; a write that breaks off leaves a version that nobody reads. Queues
are written again only when they have passed a multiple of ``every`` events since their last snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import replay
from tidemark.schemas import QUEUE
from tidemark.sources.shared import cut
from tidemark.sources.store import Store

EVERY = 50_000


def due(before: Column, after: Column, every: int = EVERY) -> Column:
    """Whether a multiple of ``every`` lies in (before, after]: batches can't step over it."""
    return F.floor(after / every) > F.floor(before / every)


def versions(root: str) -> list[int]:
    store = Store(root)
    return [int(name[2:]) for name, size in store.entries(store.root) if size is None and name.startswith("v=") and store.exists(store.at(name, "_SUCCESS"))]


def latest(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of the latest version: offset_state with upto; a queue without any offset has one row with a null offset."""
    found = versions(root)
    return spark.read.parquet(f"{root}/v={max(found):012d}") if found else None


def recover(events: DataFrame, root: str) -> DataFrame:
    """offset_state of the latest snapshot and the events after it; without a snapshot, of all events."""
    kept = latest(events.sparkSession, root)
    if kept is None:
        return replay.offset_state(events)
    cuts = kept.select(*QUEUE, "upto").distinct()
    return replay.resume(kept.filter("off is not null").drop("upto"), cuts, events)


def take(events: DataFrame, root: str, every: int = EVERY, keep: int = 2) -> int | None:
    """Write a new version if any queue is due, and drop all but the last ``keep``; its number, or None.

    ``events`` may be the whole log: what lies before a queue's snapshot isn't applied again.
    """
    spark = events.sparkSession
    kept = latest(spark, root)
    now = events.groupBy(*QUEUE).agg((F.max("seq") + 1).alias("now"))
    old = kept.select(*QUEUE, "upto").distinct() if kept is not None else now.select(*QUEUE, F.lit(0).cast("long").alias("upto")).limit(0)
    queues = cut(now.join(old, QUEUE, "full").withColumn("upto", F.coalesce("upto", F.lit(0))).withColumn("due", F.coalesce(due(F.col("upto"), F.col("now"), every), F.lit(False))))
    if queues.filter("due").first() is None:
        return None
    fresh = queues.filter("due").select(*QUEUE, F.col("now").alias("upto"))
    state = cut(recover(events.join(fresh.select(*QUEUE), QUEUE, "left_semi"), root).join(fresh, QUEUE))  # it is looked at twice
    empty = fresh.join(state.select(*QUEUE).distinct(), QUEUE, "left_anti")
    rows = state.unionByName(empty, allowMissingColumns=True)
    if kept is not None:
        rows = rows.unionByName(kept.join(fresh.select(*QUEUE), QUEUE, "left_anti"))
    found = versions(root)
    number = max(found, default=0) + 1
    rows.write.mode("overwrite").parquet(f"{root}/v={number:012d}")
    store = Store(root)
    for v in sorted([*found, number])[:-keep]:
        store.remove_tree(store.at(f"v={v:012d}"))
    return number
