"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks. With weight w (of a total of one) a source's block i (from 0) is
released at floor(i / w) and due at ceil((i + 1) / w), in slots of one block; the earliest deadline among the
released blocks goes first (ties: the earlier release, then the source's name). Releases and deadlines are
worked out in whole numbers from the exact weights, so after any number t of slots, however large, a source has had
less than one block more or less than w * t.

The schedule has a slot for each block and is made on the driver. A block is ``block`` documents, or as many more as
keep the slots at MAX_SLOTS, so the driver's work has a bound whatever the corpus; it reaches the executors as two
numbers a slot. When a source runs out, the others go on with their weights scaled up to one: a new phase. No
document is dropped or repeated; phase 0 is the part in which all target weights hold.

Documents are ordered within a source by a hash. Their numbers come from counts of (source, bucket) and a
row number within a bucket, so a source of any size is dealt to many tasks. The slots of a bucket's blocks
are joined to it as one array, on the buckets by which the documents were dealt already: documents are shuffled once.

Edge cases: a null source is a source of its own. A source without a target weight (or of weight zero)
comes after all others, in phases of its own. Repeated rows are documents of their own; rows alike in all columns lie in
one bucket. The last block of a source may be short. An empty table gives an empty result. Columns of the input
that are called mix_phase, mix_slot or mix_position are replaced; all others pass through, whatever they are called.
"""

from __future__ import annotations

import heapq
import itertools
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import free, row_hash

BLOCK, BUCKET_ROWS, MAX_SLOTS, MAX_SOURCES = 64, 20_000, 1_000_000, 5000
NONE = "\u0000"


def exact(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights, which count at their full binary value."""
    parts = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(p.denominator for p in parts.values()))
    return {s: int(p * scale) for s, p in parts.items()}


def schedule(weights: dict[str, int]):
    """The source of each slot, without end: earliest deadline first among the released blocks."""
    total = sum(weights.values())
    waiting = [(0, s, 0) for s in weights]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    for t in itertools.count():
        while waiting and waiting[0][0] <= t:
            release, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // weights[s]), release, s, i))
        _, _, s, i = heapq.heappop(ready)
        yield s
        heapq.heappush(waiting, ((i + 1) * total // weights[s], s, i + 1))


def phases(blocks: dict[str, int], weights: dict[str, float]):
    """(phase, source) of each slot, until every source's blocks are placed. A phase ends with the slot in which a source's last block stands."""
    left = {s: n for s, n in blocks.items() if n > 0}
    number = 0
    while left:
        live = exact({s: weights.get(s, 0.0) for s in left if weights.get(s, 0.0) > 0} or dict.fromkeys(left, 1.0))
        for s in schedule(live):
            yield number, s
            left[s] -= 1
            if not left[s]:
                del left[s]
                break
        number += 1


def source_sizes(docs: DataFrame, source: str = "source") -> dict[str, int]:
    """Documents by source. More than MAX_SOURCES sources are refused: they are metadata and held on the driver."""
    rows = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit(NONE)).alias("s")).count().limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; give the column of a coarser grouping")
    return {r[0]: r[1] for r in sorted(rows)}


def slot_table(spark, blocks: dict[str, int], weights: dict[str, float]) -> DataFrame:
    """(s, block, phase, slot) of every block of every source."""
    names = sorted(blocks)
    number = {s: i for i, s in enumerate(names)}
    n = sum(blocks.values())
    made = np.fromiter((x for phase, s in phases(blocks, weights) for x in (phase, number[s])), np.int32, 2 * n).reshape(-1, 2)
    # the how-many-eth slot of its source each one is
    order = np.argsort(made[:, 1], kind="stable")
    starts = np.searchsorted(made[order, 1], np.arange(len(names)))
    own = np.empty(n, np.int32)
    own[order] = np.arange(n) - starts[made[order, 1]]
    shared = spark.sparkContext.broadcast((names, np.ascontiguousarray(made[:, 0]), np.ascontiguousarray(made[:, 1]), own))

    def run(batches):
        names, phase, source, block = shared.value
        texts = pa.array(names, pa.string())
        for b in batches:
            at = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([texts.take(pa.array(source[at])), pa.array(block[at].astype(np.int64)), pa.array(phase[at]), b.column(0)], names=["s", "block", "phase", "slot"])

    return spark.range(n, numPartitions=max(1, min(64, n // 50_000))).mapInArrow(run, "s string, block long, phase int, slot long")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", block: int = BLOCK, max_slots: int = MAX_SLOTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All rows of ``docs`` with mix_phase, mix_slot (the block's place) and mix_position (the row's place).

    Order by mix_position to read the mixture. ``weights`` maps sources to target weights; without it they
    are the square roots of the sources' documents, counted over all rows.
    """
    spark = docs.sparkSession
    docs = docs.drop(*({"mix_phase", "mix_slot", "mix_position"} - {source}))
    sizes = source_sizes(docs, source)
    weights = {s: n**0.5 for s, n in sizes.items()} if weights is None else weights
    total = sum(sizes.values())
    block = max(block, -(-total // max_slots))
    slots = slot_table(spark, {s: -(-n // block) for s, n in sizes.items()}, weights)
    buckets = max(64, total // bucket_rows)
    s, b, h, r, o, at, found = free(docs.columns, "_s", "_b", "_h", "_r", "_o", "_at", "_found")
    keyed = docs.withColumn(s, F.coalesce(F.col(source).cast("string"), F.lit(NONE))).withColumn(h, row_hash(docs, "mix")).withColumn(b, F.pmod(h, F.lit(buckets)))
    counts = keyed.groupBy(s, b).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(s).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.select(F.col(s).alias("s"), b, "n", before.alias(o))
    spans = spans.select("s", b, o, F.explode(F.sequence(F.floor(F.col(o) / block), F.floor((F.col(o) + F.col("n") - 1) / block))).alias("block"))
    placed = spans.join(slots, ["s", "block"]).groupBy("s", b, o).agg(F.array_sort(F.collect_list(F.struct("block", "slot", "phase"))).alias(at)).withColumnRenamed("s", s)
    numbered = keyed.withColumn(r, F.row_number().over(Window.partitionBy(s, b).orderBy(h)) - 1).join(placed, [s, b])
    number = F.col(o) + F.col(r)
    mine = F.element_at(at, (F.floor(number / block) - F.floor(F.col(o) / block) + 1).cast("int"))
    done = numbered.withColumn(found, mine)
    position = F.col(found)["slot"] * block + number % block
    return done.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(found)["phase"].alias("mix_phase"), F.col(found)["slot"].alias("mix_slot"), position.alias("mix_position"))
