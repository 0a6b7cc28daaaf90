"""The exact sequential fold of one queue, with the bounded window as an option.

It is needed only where a settlement can land ``ack_window`` or more beyond the frontier and is then to be
forgotten. A queue is folded by one task, as its events depend on each other. The task gets them in order, a batch at a time, and holds
some 20 bytes for each offset of the queue since its last reset; replay.offset_state has no such limit, and snapshots or resets shorten what is folded.
"""

from __future__ import annotations

import itertools
from array import array
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import MAX_RETRIES, OFFSET_STATE, QUEUE

ROWS = 8192


@dataclass
class QueueFold:
    """What is known of a queue: the settled prefix, settled offsets beyond it, leases, retries."""

    ack_window: int | None = None
    frontier: int = 0
    ahead: set[int] = field(default_factory=set)
    leases: dict[int, int] = field(default_factory=dict)
    retries: dict[int, int] = field(default_factory=dict)
    touched: set[int] = field(default_factory=set)

    def is_settled(self, off: int) -> bool:
        return off < self.frontier or off in self.ahead

    def settle(self, off: int) -> None:
        self.leases.pop(off, None)
        if off > self.frontier:
            if self.ack_window is None or off < self.frontier + self.ack_window:
                self.ahead.add(off)
        elif off == self.frontier:
            self.frontier += 1
            while self.frontier in self.ahead:
                self.ahead.remove(self.frontier)
                self.frontier += 1

    def nack(self, off: int, requeue: bool) -> None:
        if not requeue:
            return self.settle(off)
        tries = self.retries.get(off, 0)
        if tries >= MAX_RETRIES:
            self.settle(off)
            self.retries.pop(off, None)
        else:
            self.leases.pop(off, None)
            self.retries[off] = tries + 1

    def apply(self, kind: str, off: int | None, retries: int | None = None, deadline: int | None = None, requeue: bool | None = None) -> None:
        if kind == "ResetQueue":
            self.frontier = 0
            for kept in (self.ahead, self.leases, self.retries, self.touched):
                kept.clear()
            return
        self.touched.add(off)
        if kind in ("Ack", "DeadLetter", "Reject"):
            self.settle(off)
        elif kind == "Nack":
            self.nack(off, bool(requeue))
        elif kind == "ClearInflight":
            self.leases.pop(off, None)
        elif kind == "Enqueue" and not self.is_settled(off):
            self.retries[off] = retries or 0
        elif kind == "MarkInflight" and not self.is_settled(off):
            self.leases[off] = deadline
            self.retries.pop(off, None)
        elif kind not in ("Enqueue", "MarkInflight"):
            raise ValueError(f"event {kind} can't be applied")

    def pop_expired(self, now: int, most: int) -> list[tuple[int, int]]:
        """Take out leases due by ``now``: earliest deadline first, larger offsets first among equals."""
        due = sorted(((d, -o) for o, d in self.leases.items() if d <= now))[:most]
        for _, o in due:
            del self.leases[-o]
        return [(-o, d) for d, o in due]

    def next_deliverable(self, start: int, upper: int) -> int:
        off = max(start, self.frontier)
        while off < upper and (off in self.leases or off in self.ahead):
            off += 1
        return min(off, upper) if off < upper else upper

    def rows(self) -> list[tuple]:
        """(off, settled, inflight, deadline, enqueued, retries) of the offsets that had an event."""
        return [(o, self.is_settled(o), o in self.leases, self.leases.get(o), o in self.retries, self.retries.get(o)) for o in sorted(self.touched)]


PAGE = 64
ABSENT = -(1 << 63)


class Numbers:
    """A dict of whole numbers by offset, in pages: 8 bytes each where offsets lie close. A value of None is allowed."""

    def __init__(self):
        self.pages: dict[int, array] = {}

    def get(self, off: int, other: int | None = None) -> int | None:
        page = self.pages.get(off // PAGE)
        v = ABSENT if page is None else page[off % PAGE]
        return other if v == ABSENT else None if v == ABSENT + 1 else v

    def __contains__(self, off: int) -> bool:
        page = self.pages.get(off // PAGE)
        return page is not None and page[off % PAGE] != ABSENT

    def __setitem__(self, off: int, value: int | None) -> None:
        page = self.pages.get(off // PAGE)
        if page is None:
            page = self.pages[off // PAGE] = array("q", [ABSENT]) * PAGE
        page[off % PAGE] = ABSENT + 1 if value is None else value

    def pop(self, off: int, other: int | None = None) -> int | None:
        page = self.pages.get(off // PAGE)
        if page is None or page[off % PAGE] == ABSENT:
            return other
        v, page[off % PAGE] = page[off % PAGE], ABSENT
        return None if v == ABSENT + 1 else v

    def clear(self) -> None:
        self.pages.clear()


class Offsets:
    """A set of offsets, in pages of a bit each."""

    def __init__(self):
        self.pages: dict[int, int] = {}

    def __contains__(self, off: int) -> bool:
        return bool(self.pages.get(off // PAGE, 0) >> off % PAGE & 1)

    def add(self, off: int) -> None:
        self.pages[off // PAGE] = self.pages.get(off // PAGE, 0) | 1 << off % PAGE

    def remove(self, off: int) -> None:
        left = self.pages[off // PAGE] & ~(1 << off % PAGE)
        if left:
            self.pages[off // PAGE] = left
        else:
            del self.pages[off // PAGE]

    def __iter__(self):
        """The offsets, in order."""
        for p in sorted(self.pages):
            bits = self.pages[p]
            yield from (p * PAGE + i for i in range(PAGE) if bits >> i & 1)

    def clear(self) -> None:
        self.pages.clear()


def fold_state(events: DataFrame, ack_window: int | None = None) -> DataFrame:
    """offset_state by applying each queue's events one after the other, a batch at a time."""
    names = [x.split()[0] for x in OFFSET_STATE.split(", ")]
    kinds = dict(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()), strict=True))

    def told(topic: str, part: int, q: QueueFold):
        """Rows of a queue, ROWS of them at a time."""
        offs = iter(q.touched)
        while some := list(itertools.islice(offs, ROWS)):
            rows = ((topic, part, o, q.is_settled(o), o in q.leases, q.leases.get(o), o in q.retries, q.retries.get(o)) for o in some)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    def run(batches):
        key, q = None, None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                rows = zip(*(c.to_pylist() for c in b.slice(at, ROWS).columns), strict=True)
                for topic, part, kind, off, retries, deadline, requeue in rows:
                    if (topic, part) != key:
                        if q is not None:
                            yield from told(*key, q)
                        key, q = (topic, part), QueueFold(ack_window, 0, Offsets(), Numbers(), Numbers(), Offsets())
                    q.apply(kind, off, retries, deadline, requeue)
        if q is not None:
            yield from told(*key, q)

    cols = [*QUEUE, "event_type", "off", "retries", "deadline", "requeue"]
    dealt = events.select(*cols, "seq").repartition(*QUEUE).sortWithinPartitions(*QUEUE, "seq")
    return dealt.select(F.col("topic"), F.col("part").cast("long"), "event_type", *[F.col(c).cast("long") for c in ("off", "retries", "deadline")], "requeue").mapInArrow(run, OFFSET_STATE)
