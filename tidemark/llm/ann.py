"""Approximate nearest neighbours with balanced posting lists.

Centroids are fitted on a bounded sample by k-means that charges full clusters, so that lists come out
alike in size. Every vector goes to the list of its nearest centroid and, if it lies near a boundary, to the
lists of the next nearest centroids within ``spread`` times that distance, up to COPIES lists in all.
Centroids are searched by a best-first walk over an in-memory neighbour graph. A query probes all lists
whose centroid is within ``probe`` times the distance of its nearest one: the ratio alone decides, there is
no cap. Lists longer than ``part_rows`` are dealt into parts by a hash of the id, and a query visits all
parts; the queries of a list are dealt into parts of ``query_rows`` in the same way. Scores of the best are computed again in
double precision from the original vectors.

Inner products are turned into distances by one more component, sqrt(longest^2 - |x|^2), with the longest
norm taken over all vectors but those of more than FAR times the median norm: beside them all others would look alike. These
are a list of their own (OUTER), which every query visits. Norms are taken as logarithms, so no finite vector overflows.
A score that is not a number (infinite parts of both signs) counts as the least.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
length differs from the most frequent one (the smaller length, on a tie). Rows with a null id are left out.
Repeated ids: each row is a candidate, an id appears once in a result, with its best score. Fewer
candidates than ``k`` give them all; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import cut, slices, uniform

SAMPLE, LIST_ROWS, PART_ROWS, MAX_LISTS, SPREAD, COPIES, PROBE, LEAST_LISTS = 20_000, 200, 20_000, 4096, 1.05, 3, 1.15, 8
WIDE, FIRST, QUERY_ROWS, FAR, OUTER = 16, 2, 50_000, 8.0, -1
SLACK = 1e-6


def valid(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(id_).isNotNull() & v.isNotNull() & (F.size(v) > 0)
    fine = fine & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(fine).select(F.col(id_).cast("long").alias("vec_id"), v.alias("v"))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (usual[0] if usual else 0))


def log_norms(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1)
    return np.log2(most) + np.log2(((x / most[:, None]) ** 2).sum(axis=1)) / 2


def measured(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, v) with r, the logarithm to base 2 of the vector's norm."""
    def run(batches):
        for b in slices(batches):
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(log_norms(v))], names=["vec_id", "v", "r"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, r double")


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that turns inner products into distances."""
    extra = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
    return np.concatenate((x, extra[:, None]), axis=1)


class CentroidIndex:
    """Centroids and the graph over them. ``median`` and ``limit`` are logarithms: vectors are divided by the median norm; beyond the limit they are outer ones."""

    median, limit = 0.0, np.inf

    def __init__(self, centroids: np.ndarray, longest: float, degree: int = 24):
        self.c, self.longest = centroids, longest
        self.sq = (centroids * centroids).sum(axis=1)
        k = len(centroids)
        near = []
        for at in range(0, k, 512):
            d = self.sq[None] - 2 * centroids[at : at + 512] @ centroids.T
            near.append(np.argsort(d, axis=1)[:, : degree + 1])
        # the nearest neighbours of each centroid, itself among them
        self.graph = np.concatenate(near) if k else np.zeros((0, 1), np.int64)
        # a walk starts from spread-out entries, so that groups the graph doesn't connect are reached
        self.entries = np.unique(np.linspace(0, k - 1, min(k, max(16, int(4 * k**0.5)))).astype(int)) if k else np.zeros(0, int)

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, longest: float, rounds: int = 12, seed: int = 5) -> CentroidIndex:
        """Balanced k-means: a cluster's distances grow with its size over the fair share."""
        x = lift(sample, longest)
        r = np.random.default_rng(seed)
        lists = max(1, min(lists, len(x)))
        c = x[np.sort(r.choice(len(x), lists, replace=False))].copy()
        charge = np.zeros(lists)
        fair = len(x) / lists
        for _ in range(rounds):
            own = np.empty(len(x), int)
            typical = 0.0
            for at in range(0, len(x), 2048):
                d = (c * c).sum(axis=1)[None] - 2 * x[at : at + 2048] @ c.T
                own[at : at + 2048] = np.argmin(d + charge[None], axis=1)
                typical += float((d.min(axis=1) + (x[at : at + 2048] ** 2).sum(axis=1)).sum())
            size = np.bincount(own, minlength=lists)
            charge += 0.05 * typical / len(x) * np.clip(size / fair - 1, -0.5, 2)
            charge -= charge.min()
            total = np.zeros_like(c)
            np.add.at(total, own, x)
            full = size > 0
            c[full] = total[full] / size[full, None]
        return cls(c, longest)

    def walk(self, y: np.ndarray, ratio: float, wide: int = WIDE) -> np.ndarray:
        """Distances of each vector to the centroids that its best-first walk over the graph has seen (else infinite).

        Each round expands the nearest unexpanded centroid of every vector that is not done: one is done when that
        centroid is farther than the ``wide``-th best seen and than ``ratio`` times the best.
        """
        n, k = len(y), len(self.c)
        own = (y * y).sum(axis=1)
        d = np.full((n, k), np.inf)
        d[:, self.entries] = np.sqrt(np.maximum(own[:, None] + self.sq[self.entries] - 2 * y @ self.c[self.entries].T, 0))
        todo = d.copy()
        live, wide = np.arange(n), min(wide, k) - 1
        while len(live):
            at = todo[live].argmin(axis=1)
            nearest = todo[live, at]
            seen = d[live]
            bound = np.maximum(np.partition(seen, wide, axis=1)[:, wide], ratio * seen.min(axis=1))
            go = (nearest <= bound) & np.isfinite(nearest)
            live, at = live[go], at[go]
            todo[live, at] = np.inf
            near = self.graph[at]
            new = np.isinf(d[live[:, None], near])
            row, col = np.broadcast_to(live[:, None], near.shape)[new], near[new]
            far = np.sqrt(np.maximum(own[row] + self.sq[col] - 2 * (y[row] * self.c[col]).sum(axis=1), 0))
            d[row, col] = far
            todo[row, col] = far
        return d

    def lists(self, y: np.ndarray, ratio: float, least: int, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, list, place): the lists within ``ratio`` of the nearest and the nearest ``least``, up to ``most``, nearest first."""
        out = []
        for a in range(0, len(y), 512):
            # a vector that is to be stored needs its nearest few only; a query all within the ratio
            d = self.walk(y[a : a + 512], 1.0 if most else ratio)
            order = np.argsort(d, axis=1, kind="stable")
            d = np.take_along_axis(d, order, axis=1)
            place = np.arange(d.shape[1])[None]
            chosen = np.isfinite(d) & ((d <= ratio * d[:, :1]) | (place < least)) & (place < (most or d.shape[1]))
            row, col = np.nonzero(chosen)
            out.append((row + a, order[row, col], col))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3)) if out else (np.zeros(0, np.int64),) * 3


def fit(rows: DataFrame, sample: int = SAMPLE, list_rows: int = LIST_ROWS, max_lists: int = MAX_LISTS) -> CentroidIndex:
    """Fit on about ``sample`` vectors drawn by hash (a documented bound); sizes and norms cover all ``rows`` (vec_id, v, r)."""
    n, median = rows.agg(F.count("*"), F.percentile_approx("r", 0.5)).first()
    if not n:
        return CentroidIndex(np.zeros((0, 1)), 1.0)
    limit = median + float(np.log2(FAR))
    usual = rows.filter(F.col("r") <= limit)
    longest = 2.0 ** (usual.agg(F.max("r")).first()[0] - median)
    drawn = usual.filter(uniform("vec_id") < sample / n).select("v").distinct().limit(2 * sample).collect() or usual.select("v").limit(1).collect()
    x = np.array(sorted(r[0] for r in drawn)) * 2.0**-median
    lists = min(max_lists, max(1, n // list_rows), max(1, len(x) // 8))
    index = CentroidIndex.fit(x, max(lists, min(LEAST_LISTS, len(x))), longest)
    index.median, index.limit = median, limit
    return index


def assign(rows: DataFrame, shared, probe: float | None = None, spread: float = SPREAD, least: int = 1) -> DataFrame:
    """(list, vec_id, v, place): a row for each list that a vector is stored in, or that a query visits if ``probe`` is given."""
    def run(batches):
        index = shared.value
        for b in slices(batches):
            if not b.num_rows or not len(index.c):
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            if probe is None:
                outer = np.flatnonzero(log_norms(v) > index.limit)
                own = np.flatnonzero(log_norms(v) <= index.limit)
                at, found, place = index.lists(lift(v[own] * 2.0**-index.median, index.longest), spread, 1, COPIES)
                at = own[at]
            else:  # only a query's direction matters
                outer = np.arange(len(v))
                y = v / np.abs(v).max(axis=1)[:, None]
                y = np.concatenate((y, np.zeros((len(y), 1))), axis=1) * (index.longest / np.sqrt((y * y).sum(axis=1)))[:, None]
                at, found, place = index.lists(y, probe, least, None)
            at, found = np.concatenate((at, outer)), np.concatenate((found, np.full(len(outer), OUTER)))
            place = np.concatenate((place, np.full(len(outer), FIRST)))
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(place.astype(np.int32))], names=["list", "vec_id", "v", "place"])

    return rows.mapInArrow(run, "list int, vec_id long, v array<double>, place int")


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products summed in one fixed order, so equal vectors get equal scores."""
    with np.errstate(all="ignore"):
        s = (x * q[None]).sum(axis=1)
    return np.where(np.isnan(s), -np.inf, s)


def by_id(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors in the order of their ids, repeated (id, vector) rows once, and where each id begins."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    again = np.flatnonzero(ids[1:] == ids[:-1])
    if len(again):
        seen, fresh = set(), np.ones(len(ids), bool)
        for i in np.union1d(again, again + 1).tolist():
            row = (int(ids[i]), (x[i] + 0.0).tobytes())
            fresh[i] = row not in seen
            seen.add(row)
        ids, x = ids[fresh], x[fresh]
    return ids, x, np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))


def best_of(q: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, rough: np.ndarray, k: int, starts: np.ndarray) -> list[tuple[float, int]]:
    """The k best ids of a block, each with its best score, by score and then id. Ids are in order; ``starts`` is where each begins."""
    best = np.maximum.reduceat(rough, starts) if len(starts) < len(ids) else rough
    best = best[ids[starts] != own]
    keep = ids != own
    if len(best) > k and np.isfinite(rough).all():  # else all are scored
        least = np.partition(best, -k)[-k]
        keep &= rough >= least - SLACK * (1 + abs(least))
    at = np.flatnonzero(keep)
    s = exact(q, x[at])
    order = np.lexsort((ids[at], -s))
    _, first = np.unique(ids[at][order], return_index=True)
    return [(float(s[i]), int(ids[at[i]])) for i in order[np.sort(first)[:k]]]


def visit(stored: DataFrame, asked: DataFrame, k: int, part_rows: int = PART_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, vec_id, score) of the lists that are asked for: of each list part, what reaches the query's bound, the k best ids at most.

    ``asked`` is (list, vec_id, v, bound). Rows of a list meet its queries by (list, part of the rows, part of the queries).
    """
    in_parts = lambda df, rows, name: df.groupBy("list").agg(F.ceil(F.count("*") / rows).alias(name))
    # a row for each list, of which there are MAX_LISTS and one
    sizes = F.broadcast(in_parts(stored, part_rows, "parts").join(in_parts(asked, query_rows, "asks"), "list"))
    share = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = stored.join(sizes, "list").withColumn("part", share("parts")).withColumn("ask", every("asks"))
    right = asked.join(sizes, "list").withColumn("part", every("parts")).withColumn("ask", share("asks"))
    cols = ["list", "part", "ask", "vec_id", "v", "bound"]
    both = left.withColumn("bound", F.lit(None).cast("double")).select(*cols).union(right.select(*cols))

    def run(table):
        bound = table.column("bound").to_numpy()
        asks = ~np.isnan(bound)
        ids = table.column("vec_id").to_numpy()
        x = np.array(table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(ids), -1)
        cand, cand_ids, qs, q_ids, low = x[~asks], ids[~asks], x[asks], ids[asks], bound[asks]
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(cand):
            cand_ids, cand, starts = by_id(cand_ids, cand)
            for at in range(0, len(qs), 256):
                q, own, floor = qs[at : at + 256], q_ids[at : at + 256], low[at : at + 256]
                with np.errstate(all="ignore"):
                    rough = q @ cand.T
                    slack = np.where(np.isfinite(floor), SLACK * (1 + np.abs(floor)), 0)
                hit = (rough >= (floor - slack)[:, None]) & (cand_ids[None] != own[:, None])
                many = (hit.sum(axis=1) > k) | ~np.isfinite(rough).all(axis=1)
                for i in np.flatnonzero(many).tolist():
                    best = best_of(q[i], own[i], cand_ids, cand, rough[i], k, starts)
                    out.append((np.full(len(best), own[i]), np.array([b for _, b in best], np.int64), np.array([b for b, _ in best])))
                hit[many] = False
                r, c = np.nonzero(hit)
                out.append((own[r], cand_ids[c], (cand[c] * q[r]).sum(axis=1)))
        return pa.table({name: np.concatenate([o[i] for o in out]) for i, name in enumerate(("query_id", "vec_id", "score"))})

    return both.groupBy("list", "part", "ask").applyInArrow(run, "query_id long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 20, spread: float = SPREAD, probe: float = PROBE, least: int = LEAST_LISTS, list_rows: int = LIST_ROWS, part_rows: int = PART_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (a condition on vec_id), among all others.

    A query's FIRST nearest lists are searched first. The k-th score found there is a bound that lets the
    other lists answer with what can still matter only.
    """
    spark = vectors.sparkSession
    rows = cut(measured(valid(vectors)))  # what is asked of each component is asked once
    shared = spark.sparkContext.broadcast(fit(rows, list_rows=list_rows))
    stored = cut(assign(rows.drop("r"), shared, spread=spread).select("list", "vec_id", "v"))
    probes = cut(assign(rows.drop("r").filter(is_query).dropDuplicates(["vec_id", "v"]), shared, probe=probe, least=least))
    none = F.lit(float("-inf"))
    first = cut(ranked(visit(stored, probes.filter(F.col("place") < FIRST).withColumn("bound", none), k, part_rows, query_rows), k))
    bounds = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(none).alias("bound")).withColumnRenamed("query_id", "vec_id")
    rest = probes.filter(F.col("place") >= FIRST).join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", none))
    found = first.select("query_id", "vec_id", "score").union(visit(stored, rest, k, part_rows, query_rows))
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")
