"""Queue state as a stream: a stateful processor for each (topic, part), and sinks by micro-batch.

Needs the RocksDB state store:
spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.fold import QueueFold
from tidemark.schemas import QUEUE, QUEUE_STATE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Kept:
    """A map in the state store that is read and written by key; what a batch doesn't name stays there."""

    def __init__(self, state, size: int):
        self.state, self.size = state, size
        self.seen: dict[int, int | None] = {}
        self.changed: set[int] = set()

    def get(self, off: int, default=None):
        if off not in self.seen:
            self.seen[off] = self.state.getValue((off,))[0] if self.state.containsKey((off,)) else None
        return default if self.seen[off] is None else self.seen[off]

    def __contains__(self, off: int) -> bool:
        return self.get(off) is not None

    def __getitem__(self, off: int):
        if (found := self.get(off)) is None:
            raise KeyError(off)
        return found

    def __setitem__(self, off: int, value: int) -> None:
        self.size += off not in self
        self.seen[off] = value
        self.changed.add(off)

    def pop(self, off: int, default=None):
        found = self.get(off, default)
        if off in self:
            self.size -= 1
            self.seen[off] = None
            self.changed.add(off)
        return found

    def add(self, off: int) -> None:
        self[off] = 1

    def remove(self, off: int) -> None:
        self.pop(off)

    __delitem__ = remove

    def __len__(self) -> int:
        return self.size

    def store(self) -> None:
        for off in self.changed:
            if self.seen[off] is not None:
                self.state.updateValue((off,), (self.seen[off],))
            elif self.state.containsKey((off,)):
                self.state.removeKey((off,))
        self.changed = set()

    def items(self):
        self.store()
        return [(k[0], v[0]) for k, v in self.state.iterator()]

    def values(self):
        return [v for _, v in self.items()]

    def clear(self) -> None:
        self.state.clear()
        self.seen, self.changed, self.size = {}, set(), 0


class Leases(Kept):
    """Leases with their earliest deadline, which is looked for again only when its own lease goes."""

    def __init__(self, state, size: int, least: int | None):
        super().__init__(state, size)
        self.least, self.stale = least, False

    def __setitem__(self, off: int, value: int) -> None:
        self.stale |= self.get(off) == self.least is not None
        super().__setitem__(off, value)
        self.least = value if self.least is None else min(self.least, value)

    def pop(self, off: int, default=None):
        found = super().pop(off, default)
        self.stale |= found is not None and found == self.least
        return found

    def clear(self) -> None:
        super().clear()
        self.least, self.stale = None, False

    def earliest(self) -> int | None:
        if self.stale or not self.size:
            self.least = min(self.values(), default=None) if self.size else None
            self.stale = False
        return self.least


class Untold:
    """Takes what is added and keeps nothing."""

    def add(self, off: int) -> None:
        pass

    def clear(self) -> None:
        pass


class QueueProcessor(StatefulProcessor):
    """Applies the events of a queue in order of seq and gives its summary after each micro-batch.

    Settlements beyond the frontier, leases and retries are kept by offset and read by key, so a batch touches only what it names (a
    reset, or the end of the earliest lease, goes through what is left). With ``expire`` a processing-time timer at the earliest
    deadline drops the leases that have run out, as ClearInflight would; a timer that is no longer the earliest is deleted.
    """

    def __init__(self, ack_window: int | None = None, expire: bool = False):
        self.ack_window, self.expire = ack_window, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "frontier long, upto long, n_ahead long, n_leases long, n_retries long, least long, timer long")
        self.maps = [handle.getMapState(name, "off long", "value long") for name in ("ahead", "leases", "retries")]

    def _load(self) -> tuple[QueueFold, int, int | None]:
        frontier, upto, n_ahead, n_leases, n_retries, least, timer = self.head.get() if self.head.exists() else (0, 0, 0, 0, 0, None, None)
        ahead, leases, retries = self.maps
        return QueueFold(self.ack_window, frontier, Kept(ahead, n_ahead), Leases(leases, n_leases, least), Kept(retries, n_retries), Untold()), upto, timer

    def _store(self, key, q: QueueFold, upto: int, timer: int | None) -> pd.DataFrame:
        for kept in (q.ahead, q.leases, q.retries):
            kept.store()
        least = q.leases.earliest()
        if self.expire and least != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if least is not None:
                self.handle.registerTimer(least)
            timer = least
        self.head.update((q.frontier, upto, len(q.ahead), len(q.leases), len(q.retries), least, timer))
        names = [x.split()[0] for x in QUEUE_STATE.split(", ")]
        row = (key[0], key[1], q.frontier, q.frontier + len(q.ahead), len(q.leases), len(q.retries), least, upto)
        return pd.DataFrame([row], columns=names).astype({"min_deadline": "Int64"})

    def handleInitialState(self, key, initialState, timerValues):
        q, upto, timer = self._load()
        num = lambda v: None if pd.isna(v) else int(v)
        for row in initialState.itertuples(index=False):
            q.frontier, upto, off = int(row.acked_until), int(row.upto), num(row.off)
            if off is None:
                continue
            if row.settled and off > q.frontier:
                q.ahead.add(off)
            if row.inflight:
                q.leases[off] = int(row.deadline)
            if row.enqueued:
                q.retries[off] = int(row.retries)
        self._store(key, q, upto, timer)

    def handleInputRows(self, key, rows, timerValues):
        q, upto, timer = self._load()
        pdf = pd.concat(list(rows)).sort_values("seq")
        num = lambda v: None if pd.isna(v) else int(v)
        for seq, kind, off, retries, deadline, requeue in zip(pdf["seq"], pdf["event_type"], pdf["off"], pdf["retries"], pdf["deadline"], pdf["requeue"], strict=True):
            if seq >= upto:  # an event that a retried batch brings again has no effect
                q.apply(kind, num(off), num(retries), num(deadline), None if pd.isna(requeue) else bool(requeue))
                upto = int(seq) + 1
        yield self._store(key, q, upto, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        q, upto, _ = self._load()
        q.pop_expired(timerValues.getCurrentProcessingTimeInMs(), len(q.leases))
        yield self._store(key, q, upto, None)

    def close(self) -> None:
        pass


def initial_state(snapshot: DataFrame) -> DataFrame:
    """A snapshot (offset_state with upto) as the beginning of a stream: what lies beyond each queue's frontier, and the frontier itself."""
    from tidemark.operators.replay import frontier

    reached = snapshot.select(*QUEUE, "upto").distinct().join(frontier(snapshot.filter("settled")), QUEUE, "left").fillna({"acked_until": 0})
    open_ = snapshot.drop("upto").join(reached, QUEUE).filter("off >= acked_until or enqueued")
    heads = reached.select(*QUEUE, "upto", "acked_until")
    return open_.unionByName(heads, allowMissingColumns=True).select(*QUEUE, "off", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("settled", "inflight", "enqueued")], "deadline", "retries", "upto", "acked_until")


def queue_state_stream(events: DataFrame, ack_window: int | None = None, expire: bool = False, snapshot: DataFrame | None = None) -> DataFrame:
    """queue_state rows (update mode) of a stream of queue_events, from a snapshot (offset_state with upto) on if there is one."""
    cols = [*QUEUE, "seq", "event_type", "off", "retries", "deadline", "requeue"]
    mode = "ProcessingTime" if expire else "None"
    start = initial_state(snapshot).groupBy(*QUEUE) if snapshot is not None else None
    return events.select(*cols).groupBy(*QUEUE).transformWithStateInPandas(QueueProcessor(ack_window, expire), QUEUE_STATE, "Update", mode, initialState=start)


def publish(messages: DataFrame, root: str, order: str = "arrival", commit_id: str | None = None) -> DataFrame:
    """Append messages, then an Enqueue event for each: the ordered publish of one micro-batch; (topic, part, offset) of each.

    ``messages`` has topic, part, payload and an order column. Numbers go on where the logs end. With a ``commit_id`` (the query
    and batch number, in foreachBatch) a batch that is brought again is neither stored nor numbered twice, wherever it broke off.
    """
    from tidemark.operators import events as made
    from tidemark.operators.scans import assign_offsets
    from tidemark.sources.log import append, ends
    from tidemark.sources.shared import cut

    spark = messages.sparkSession
    placed = cut(assign_offsets(messages, [order], ends(spark, root, commit_id=commit_id)).withColumnRenamed("off", "offset"))
    append(placed.select(*QUEUE, "offset", "payload"), root, commit_id=commit_id)
    rows = made.encoded(made.enqueue(placed.select(*QUEUE, F.col("offset").alias("off")))).select(*QUEUE, F.col("off").alias("_at"), "payload")
    append(rows, root, ["_at"], kind="events", commit_id=commit_id)
    return placed.select(*QUEUE, "offset")
