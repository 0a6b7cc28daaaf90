"""Rows of queue events: what a consumer or producer writes, and appending them to an event log."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import codec
from tidemark.schemas import QUEUE

FIELDS = {"off": "long", "retries": "long", "deadline": "long", "requeue": "boolean", "blob": "binary"}


def event(kind: str, items: DataFrame, **values: Column) -> DataFrame:
    """An event of ``kind`` for each row of ``items`` (topic, part, off), with the given fields; other columns stay for ordering."""
    rest = [c for c in items.columns if c not in (*QUEUE, *FIELDS, "event_type")]
    made = [values.get(c, F.col(c) if c == "off" and "off" in items.columns else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()]
    return items.select(*QUEUE, *rest, F.lit(kind).alias("event_type"), *made)


def enqueue(items: DataFrame, retries: int = 0) -> DataFrame:
    return event("Enqueue", items, retries=F.lit(retries))


def mark_inflight(items: DataFrame, deadline: Column) -> DataFrame:
    return event("MarkInflight", items, deadline=deadline)


def ack(items: DataFrame) -> DataFrame:
    return event("Ack", items)


def nack(items: DataFrame, requeue: bool = True) -> DataFrame:
    return event("Nack", items, requeue=F.lit(requeue))


def dead_letter(items: DataFrame) -> DataFrame:
    return event("DeadLetter", items)


def clear_inflight(items: DataFrame) -> DataFrame:
    return event("ClearInflight", items)


def reset(queues: DataFrame) -> DataFrame:
    return event("ResetQueue", queues)


def encoded(events: DataFrame) -> DataFrame:
    """``events`` with payload, the bytes of each event; a batch of rows at a time."""
    cols = ["event_type", *QUEUE, *FIELDS]

    def run(batches):
        for b in batches:
            fields = [b.column(b.schema.get_field_index(c)).to_pylist() for c in cols]
            made = codec.encode_events(zip(*fields, strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=[*b.schema.names, "payload"])

    return events.mapInArrow(run, T.StructType([*events.schema.fields, T.StructField("payload", T.BinaryType())]))


def append_events(events: DataFrame, root: str, order: list[str], commit_id: str | None = None) -> DataFrame:
    """Append events to their queues' event logs, in ``order``; (topic, part, first_offset, next_offset, n) once they are on disk.

    next_offset is the applied_upto that the state has when all of them are applied.
    """
    from tidemark.sources.log import append

    rows = events.select(*dict.fromkeys((*QUEUE, *order, "event_type", *FIELDS))).withColumnRenamed("off", "event_off")
    return append(rows, root, order, kind="events", commit_id=commit_id, prepare=lambda dealt: encoded(dealt.withColumnRenamed("event_off", "off")).select(*QUEUE, "offset", "payload"))
