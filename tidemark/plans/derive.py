"""Log records and queue events made of the events table, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.schemas import QUEUE


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, part, off, ts_ms, event_id, flags, headers, payload: a log for each (topic, part)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    rows = e.select(
        F.col("event_type").alias("topic"),
        (F.col("user_id") % 4).cast("long").alias("part"),
        F.floor(micros / 1000).cast("long").alias("ts_ms"),
        "event_id",
        (F.col("event_id") % 4).cast("int").alias("flags"),
        F.encode("event_type", "utf-8").alias("headers"),
        F.encode("props", "utf-8").alias("payload"),
    )
    w = Window.partitionBy(*QUEUE).orderBy("event_id")
    return rows.withColumn("off", (F.row_number().over(w) - 1).cast("long"))


def _event(ph: int, kind: str, t: Column, retries=None, deadline=None, requeue=None) -> Column:
    return F.struct(
        t.cast("long").alias("t"),
        F.lit(ph).alias("ph"),
        F.lit(kind).alias("event_type"),
        F.lit(retries).cast("long").alias("retries"),
        F.lit(deadline).cast("long").alias("deadline"),
        F.lit(requeue).cast("boolean").alias("requeue"),
    )


def queue_events(msgs: DataFrame, variant: str = "a") -> DataFrame:
    """The life of every message as events, numbered by seq within a queue.

    Variant b acknowledges all but every 97th message, for long settled prefixes.
    """
    ident, ts = F.col("event_id"), F.col("ts_ms")
    ten, later = ident % 10, ts + 2000 + (ident * 7919 % 3600) * 1000
    six = ident % 50 == 15
    if variant == "a":
        many = [
            F.when(ten < 9, _event(1, "MarkInflight", ts + 1000, deadline=ts + 31000 + (ident % 7) * 1000)),
            F.when(ten <= 4, _event(2, "Ack", later)),
            F.when((ten == 5) & ~six, _event(2, "Nack", later, requeue=True)),
            *[F.when(six, _event(2 + i, "Nack", later + i, requeue=True)) for i in range(6)],
            F.when(ten == 6, _event(2, "Nack", later, requeue=False)),
            F.when(ten == 7, _event(2, "DeadLetter", later)),
            F.when(ident % 40 == 8, _event(9, "ClearInflight", ts + 5000)),
        ]
    else:
        many = [F.when(ident % 97 != 0, _event(2, "Ack", later))]
    lives = F.filter(F.array(_event(0, "Enqueue", ts, retries=ident % 3), *many), lambda x: x.isNotNull())
    rows = msgs.select(*QUEUE, "off", F.explode(lives).alias("e")).select(*QUEUE, "off", "e.*")
    if variant == "a":
        sizes = msgs.filter("part = 3").groupBy(*QUEUE).agg(F.count("*").alias("n"))
        first = msgs.join(sizes, QUEUE).filter(F.col("off") < F.floor((F.col("n") + 1) / 2))
        resets = first.groupBy(*QUEUE).agg(F.max("ts_ms").alias("at"))
        rows = rows.unionByName(resets.select(*QUEUE, F.lit(None).cast("long").alias("off"), _event(10, "ResetQueue", F.col("at")).alias("e")).select(*QUEUE, "off", "e.*"))
    w = Window.partitionBy(*QUEUE).orderBy("t", F.coalesce("off", F.lit(-1)), "ph")
    return rows.withColumn("seq", (F.row_number().over(w) - 1).cast("long")).drop("t", "ph").withColumn("blob", F.lit(None).cast("binary"))
