"""Where a batching writer would flush: linger gaps as windows, the full rules as a fold."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scans import in_parts


def linger_sessions(rows: DataFrame, by: list[str], clock: str, order: list[str], linger: int) -> DataFrame:
    """Runs of arrivals that lie less than ``linger`` apart: session (from 1), n, first_ms, last_ms.

    An arrival exactly ``linger`` after the one before starts a new run, unlike session_window.
    """
    dealt = in_parts(rows, by, order)
    w, parts = Window.partitionBy(*by, "_p").orderBy(*order), Window.partitionBy(*by).orderBy("_p")
    last = dealt.groupBy(*by, "_p").agg(F.max_by(clock, F.struct(*order)).alias("_l")).select(*by, "_p", F.lag("_l").over(parts).alias("_l"))
    gap = F.col(clock) - F.coalesce(F.lag(clock).over(w), F.col("_l"))
    marked = dealt.join(last, [*by, "_p"]).withColumn("_new", F.coalesce((gap >= linger).cast("long"), F.lit(1)))
    counted = marked.withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # sessions are numbered within a part, then on from the parts before it; one that goes on over parts has one number
    runs = counted.groupBy(*by, "_p", "_s").agg(F.count("*").alias("n"), F.min(clock).alias("first_ms"), F.max(clock).alias("last_ms"))
    ends = runs.groupBy(*by, "_p").agg(F.max("_s").alias("_t"))
    before = F.coalesce(F.sum("_t").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = runs.join(ends.select(*by, "_p", before.alias("_o")), [*by, "_p"]).withColumn("session", F.col("_s") + F.col("_o"))
    return numbered.groupBy(*by, "session").agg(F.sum("n").alias("n"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))


@dataclass
class Batcher:
    """Collects (clock, records, bytes) and says what is flushed, and why."""

    max_items: int
    max_records: int
    max_bytes: int
    linger: int
    held: list = field(default_factory=list)
    records: int = 0
    bytes: int = 0
    last: int = 0

    def deadline(self) -> int | None:
        """When what is held has to leave; an empty one has no deadline."""
        return self.last + self.linger if self.held else None

    def remaining(self, now: int) -> int | None:
        return None if self.deadline() is None else max(0, self.deadline() - now)

    def due(self, now: int) -> bool:
        return bool(self.held) and (self.linger == 0 or now >= self.last + self.linger)

    def flush(self) -> list:
        out, self.held, self.records, self.bytes = self.held, [], 0, 0
        return out

    def push(self, now: int, item, records: int, size: int) -> list[tuple[str, list]]:
        """A batch that has gone stale leaves before the item comes in; then the limits are tested, inclusively."""
        out = [("Timeout", self.flush())] if self.due(now) else []
        self.held.append(item)
        self.records += records
        self.bytes += size
        self.last = now
        for reason, full in (("MaxItems", len(self.held) >= self.max_items), ("MaxRecords", self.records >= self.max_records), ("MaxBytes", self.bytes >= self.max_bytes)):
            if full:
                out.append((reason, self.flush()))
                break
        return out


def driven(batcher: Batcher, arrivals):
    """(reason, items) of each batch of ``arrivals`` (clock, item, records, bytes), both of an arrival that flushes twice, and of what is held at the end."""
    for now, item, records, size in arrivals:
        yield from batcher.push(now, item, records, size)
    if batcher.held:
        yield "Shutdown", batcher.flush()


def adapted_linger(linger: int, size: int, max_bytes: int, most: int, pending: bool) -> int:
    """The next linger after a batch of ``size`` bytes: longer by 1 ms (up to ``most``) after a well-filled one, shorter after a small one that nothing waits behind."""
    if size >= max_bytes // 2:
        return min(most, linger + 1)
    return max(0, linger - 1) if size < 64 << 10 and not pending else linger


def flushes(rows: DataFrame, by: list[str], clock: str, order: str, size: str, max_items: int, max_records: int, max_bytes: int, linger: int) -> DataFrame:
    """by, batch (from 0), flush_reason, n, bytes, first_ms, last_ms. What is held at the end leaves by Shutdown.

    Each decision depends on the one before, so a log is folded in order by one task, which holds its clocks and sizes (some 16 bytes
    a record: a log of 100 million records takes 2 GB).
    """
    slim = rows.select(*by, clock, order, size)
    kinds = dict(slim.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        arrivals = ((now, (now, n), 1, n) for now, n in zip(pdf[clock].tolist(), pdf[size].tolist(), strict=True))
        out = list(driven(Batcher(max_items, max_records, max_bytes, linger), arrivals))
        made = pd.DataFrame([(i, why, len(items), sum(x[1] for x in items), items[0][0], items[-1][0]) for i, (why, items) in enumerate(out)], columns=["batch", "flush_reason", "n", "bytes", "first_ms", "last_ms"])
        for k, c in enumerate(by):
            made.insert(k, c, pdf[c].iloc[0])
        return made

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", batch long, flush_reason string, n long, bytes long, first_ms long, last_ms long"
    return slim.groupBy(*by).applyInPandas(run, schema)
