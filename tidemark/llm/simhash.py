"""SimHash near-duplicates by tiled exact comparison.

Every document gets a 64-bit fingerprint of its word shingles. Distinct fingerprints are dealt into
tiles by the population counts of four 16-bit parts. Two fingerprints within ``radius`` bits have
counts that differ by ``radius`` at most in sum, so a tile meets only those tiles whose counts lie
that near; all other tile pairs are skipped, which loses nothing. Within a pair of tiles numpy
compares all fingerprints with exclusive-or and bit counts; a tile of more than CELL_ROWS rows is dealt into cells
of two row blocks each, so no task holds more. A cell returns a spanning forest of its links, never all pairs;
the forests are joined into components by distributed star contraction, which goes on until nothing changes.

The pipeline's stage (keep_one) links texts whose five-word shingle sets reach a Jaccard similarity of 0.8. Such
texts lie up to NEAR of 128 bits apart, a radius at which population counts alone skip next to nothing, so bands of minimum
hashes say which fingerprints share a tile (a pair at 0.8 shares no band with probability 3e-5); within it they
are compared in the same way, and exact counts of shared shingles decide. See similar().

Edge cases: a null or wordless text has fingerprint zero and is linked like any other. A null doc_id
gets a fingerprint and the component of the documents near it. Repeated rows each get their row back.
A text of fewer words than a shingle is one shingle. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import cut, free, row_hash, slices
from tidemark.llm.words import BASE

WORDS_IN_SHINGLE, RADIUS, SEED = 3, 2, 42
FINE_ABOVE, CELL_ROWS = 20_000_000, 1_000_000  # fingerprints from which tiles are finer; rows of a cell
STAGE_WORDS, SIMILARITY, BANDS, ROWS, NEAR, SHORT = 5, 0.8, 20, 4, 36, 40
PIECE, STARS, SENT_IDS = 20_000, 4, 4_000_000
CELLS = 1 << 21  # comparisons held at a time


def fingerprint(text: bytes | None, size: int = WORDS_IN_SHINGLE) -> int:
    """Lower-case A-Z, split at ASCII white space, hash the shingles, take each bit's majority."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    spans = zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, size: int = WORDS_IN_SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of each row."""
    def run(batches):
        for b in slices(batches):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def steps(radius: int = RADIUS, parts: int = 4) -> list[tuple[int, ...]]:
    """The differences of part counts within ``radius`` in sum, one of each opposite pair, zero left out."""
    near = (s for s in itertools.product(range(-radius, radius + 1), repeat=parts) if 0 < sum(map(abs, s)) <= radius)
    return [s for s in near if s > tuple(-x for x in s)]


def forest(node: np.ndarray, fps: np.ndarray, homes: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that connect what is within ``radius`` among homes, or between a home and a visitor.

    The first ``homes`` entries are at home. Blocks of comparisons are merged into labels as they are
    made, so memory is bounded and at most one link for each entry comes out.
    """
    n = len(fps)
    label = np.arange(n)
    rows = max(1, CELLS // max(n, 1))
    for at in range(0, homes, rows):
        to = min(homes, at + rows)
        gap = np.bitwise_count(fps[at:to, None] ^ fps[None, at:])
        a, b = np.nonzero(gap <= radius)
        a, b = a + at, b + at
        a, b = a[a != b], b[a != b]
        while len(a):
            la, lb = label[a], label[b]
            open_ = la != lb
            if not open_.any():
                break
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while (label[label] != label).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(n))
    return node[moved], node[label[moved]]


def grouped(batches, columns: int):
    """The rows of each tile as numpy arrays, from batches that are sorted by tile (the first column)."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(cols[0]):
            continue
        at = [0, *(np.flatnonzero(np.diff(cols[0])) + 1).tolist(), len(cols[0])]
        for i, j in itertools.pairwise(at):
            part = [c[i:j] for c in cols]
            if held and held[-1][0][0] != part[0][0]:
                yield [np.concatenate([h[k] for h in held]) for k in range(columns)]
                held = []
            held.append(part)
    if held:
        yield [np.concatenate([h[k] for h in held]) for k in range(columns)]


def links(distinct: DataFrame, radius: int = RADIUS, parts: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) that connect the fingerprints of ``distinct`` (fp) that lie within ``radius`` bits.

    ``parts`` says how fine the tiles are: 4 up to FINE_ABOVE fingerprints, 8 beyond, unless given. A tile whose homes and
    visitors are more than ``cell_rows`` is cut into blocks of rows, and each pair of blocks is a cell of its own.
    """
    parts = parts or (4 if distinct.count() <= FINE_ABOVE else 8)
    wide = 64 // parts
    ones = [F.bit_count(F.shiftrightunsigned("fp", wide * i).bitwiseAND((1 << wide) - 1)).cast("long") for i in range(parts)]
    base = sum((ones[i] + radius) * (wide + 2 * radius + 1) ** i for i in range(parts))
    moves = F.array(*[F.lit(sum(x * (wide + 2 * radius + 1) ** i for i, x in enumerate(s))) for s in [(0,) * parts, *steps(radius, parts)]])
    homes = distinct.select("fp", base.alias("home"))
    dealt = homes.select("fp", "home", F.explode(moves).alias("move")).select((F.col("home") + F.col("move")).alias("tile"), (F.col("move") != 0).alias("visits"), "fp")
    counts = homes.groupBy("home").agg(F.count("*").alias("n")).select(F.explode(moves).alias("move"), "home", "n")
    totals = counts.groupBy((F.col("home") + F.col("move")).alias("tile")).agg(F.sum("n").alias("n"))
    large = cut(totals.filter(F.col("n") > cell_rows).select("tile", F.ceil(F.col("n") / cell_rows).alias("pieces")))
    cell = F.col("tile").alias("cell")
    if large.first() is not None:  # no more of them than rows / cell_rows, so the list is sent to all
        dealt = dealt.join(F.broadcast(large), "tile", "left").fillna({"pieces": 1}).withColumn("own", F.pmod(F.xxhash64("fp"), "pieces"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        cell = F.xxhash64("tile", F.greatest("own", "other"), F.least("own", "other")).alias("cell")
    dealt = dealt.select(cell, "visits", "fp")

    def run(batches):
        for _, visits, fps in grouped(batches, 3):
            at_home = len(fps) - int(visits.sum())
            if at_home and len(fps) > 1:
                a, b = forest(fps, fps.view(np.uint64), at_home, radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.repartition("cell").sortWithinPartitions("cell", "visits", "fp").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, root) of every node but the roots: root is the least node reachable. Alternates large-star and small-star.

    ``edges`` is (a, b). Each round is a pre-aggregated minimum and a join on the node, checkpointed;
    the edge set halves in depth each round and the loop ends when it no longer changes. With ``rounds`` an
    unfinished loop is an error, never a result.
    """
    own = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, before = cut(own(edges)), None
    for done in itertools.count():
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before or not state[0]:
            break
        if done == rounds:
            raise RuntimeError(f"components are not joined after {rounds} rounds")
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = own(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = cut(own(large.join(least, "a").select("b", "m").union(least.select("a", "m")).toDF("a", "b")))
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def with_roots(found: DataFrame) -> DataFrame:
    """The result of components() with a row for each root as well."""
    return found.union(found.select("root", "root").distinct()).toDF("node", "root")


def near_duplicates(docs: DataFrame, size: int = WORDS_IN_SHINGLE, radius: int = RADIUS, parts: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs``."""
    fps = cut(fingerprints(docs, size))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = cut(distinct.join(with_roots(cut(components(links(distinct, radius, parts)))), F.col("fp") == F.col("node")).select("fp", "root", "least"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = linked.join(least, "root").select("fp", "component_id")
    moved = moved.union(distinct.join(linked, "fp", "left_anti").select("fp", "least"))
    # copies of one text may hold a third of the rows: adaptive execution splits their side of this join
    return fps.join(moved, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_sets(texts: pa.Array, size: int = STAGE_WORDS) -> list[np.ndarray]:
    """The distinct hashes, sorted, of each text's shingles; words are those of fingerprint(). A wordless text has none."""
    split = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(texts.cast(pa.string())), ""))
    coded, ends = split.values.dictionary_encode(), split.offsets.to_numpy()
    known = np.array([xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    blank = pc.fill_null(pc.equal(coded.dictionary, ""), False).to_numpy(zero_copy_only=False).astype(bool)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    real = ~blank[codes] if len(codes) else np.zeros(0, bool)
    ends = np.concatenate(([0], np.cumsum(real)))[ends]
    words = known[codes[real]] if len(codes) else np.zeros(0, np.uint64)
    whole = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for i in range(size):
        whole = whole * BASE + words[i : i + len(whole)]
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= size:
            found = whole[a : b - size + 1]
        else:
            found = np.zeros(min(1, b - a), np.uint64)
            for w in words[a:b]:
                found = found * BASE + w
        out.append(np.unique((found ^ (found >> np.uint64(32))) * BASE))
    return out


def spread(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of hashes."""
    h = (hashes ^ np.uint64(salt)) * BASE
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def wide_print(hashes: np.ndarray) -> list[np.ndarray]:
    """Two words of 64 bits: each bit is 1 if it is set in over half of a set's hashes."""
    ones = np.zeros(128, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.stack([spread(hashes[at : at + (1 << 14)], salt) for salt in (1, 2)], axis=1).astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def band_keys(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Keys of each set's bands of minimum hashes, one row for a set: sets of Jaccard similarity s share a band with probability s ** rows."""
    r = np.random.default_rng(SEED)
    turn = r.integers(0, 1 << 63, bands * rows, np.uint64)
    times = r.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    flat = np.concatenate(sets)
    key = np.tile(np.arange(bands, dtype=np.uint64), (len(sets), 1))
    for i in range(bands * rows):
        least = np.minimum.reduceat((flat ^ turn[i]) * times[i], starts)
        k = key[:, i // rows]
        key[:, i // rows] = (k ^ (k >> np.uint64(29))) * BASE + least
    return key.view(np.int64)


SKETCH = "doc_id long, node long, n long, keys array<long>, f1 long, f2 long"


def sketches(docs: DataFrame, size: int = STAGE_WORDS) -> DataFrame:
    """doc_id, node (a hash of the shingle set), n (its size), keys (its bands; none without words), f1 and f2 (its 128-bit fingerprint) of each row."""
    def run(batches):
        for b in slices(batches, 1000, 8):
            sets = shingle_sets(b.column(1), size)
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            prints = np.array([wide_print(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            some = [s for s in sets if len(s)]
            ends = np.concatenate(([0], np.cumsum([BANDS if len(s) else 0 for s in sets]))).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(band_keys(some).ravel() if some else np.zeros(0, np.int64)))
            columns = [b.column(0), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), keys, pa.array(np.ascontiguousarray(prints[:, 0])), pa.array(np.ascontiguousarray(prints[:, 1]))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "n", "keys", "f1", "f2"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SKETCH)


def shingle_rows(docs: DataFrame, size: int = STAGE_WORDS) -> DataFrame:
    """node and its shingles, 32 bits of each hash, of each row."""
    def run(batches):
        for b in slices(batches, 1000, 8):
            sets = shingle_sets(b.column(0), size)
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            short = [np.unique((s >> np.uint64(32)).astype(np.uint32)).view(np.int32) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(short, pa.list_(pa.int32()))], names=["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node long, shingles array<int>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the Jaccard similarity."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(shared >= similarity * (F.size("sa") + F.size("sb") - shared) - 1e-9).select("a", "b")


def fits(a: str, b: str, similarity: float) -> Column:
    """Whether two nodes' sizes and fingerprints (n, f1, f2 with these endings) allow the similarity. Fingerprints of small sets say little."""
    gap = F.bit_count(F.col(f"f1{a}").bitwiseXOR(F.col(f"f1{b}"))) + F.bit_count(F.col(f"f2{a}").bitwiseXOR(F.col(f"f2{b}")))
    small, big = F.least(f"n{a}", f"n{b}"), F.greatest(f"n{a}", f"n{b}")
    return (small >= similarity * big - 1e-9) & ((gap <= NEAR) | (small < SHORT))


def cells(batches):
    """The rows of each cell as one Arrow table, from batches that are sorted by cell (the first column)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        ids = b.column(0).to_numpy()
        if not len(ids):
            continue
        for i, j in itertools.pairwise([0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]):
            if held and held[-1].column(0)[0].as_py() != ids[i]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def joined(cell: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Links (node, node) that join the components of a cell's visitors with those of its homes, as far as sets reach the similarity.

    Blocks of visitors meet blocks of homes by size, population count (those that differ by more than NEAR are not compared), and
    the bits of their fingerprints; then shingles are counted, the nearest first. A link is made for each component that is
    met, and what is in one component by then is not looked at again, so there are fewer links than rows.
    """
    home, visits, node, n, f1, f2, label = (cell.column(i).to_numpy() for i in range(1, 8))
    sets = cell.column(8).combine_chunks() if cell.column(8).num_chunks != 1 else cell.column(8).chunk(0)
    ends, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
    f1, f2 = f1.view(np.uint64), f2.view(np.uint64)
    label = np.unique(label, return_inverse=True)[1]
    ones = np.bitwise_count(f1).astype(np.int64) + np.bitwise_count(f2)
    order = np.argsort(ones, kind="stable")
    homes, visitors = order[home[order]], order[visits[order]]
    links: list[tuple[int, int]] = []
    step = max(1, CELLS // max(1, len(homes)))
    for at in range(0, len(visitors) if len(homes) else 0, step):
        v = visitors[at : at + step]
        h = homes
        if n[v].min() >= SHORT:
            h = homes[np.searchsorted(ones[homes], ones[v[0]] - NEAR) : np.searchsorted(ones[homes], ones[v[-1]] + NEAR, side="right")]
        if not len(h):
            continue
        gap = np.bitwise_count(f1[v, None] ^ f1[None, h]) + np.bitwise_count(f2[v, None] ^ f2[None, h])
        small, big = np.minimum(n[v, None], n[None, h]), np.maximum(n[v, None], n[None, h])
        fit = (label[v, None] != label[None, h]) & (small >= similarity * big - 1e-9) & ((gap <= NEAR) | (small < SHORT))
        for i in np.flatnonzero(fit.any(axis=1)).tolist():
            x = int(v[i])
            near = np.flatnonzero(fit[i])
            left = h[near[np.argsort(gap[i, near], kind="stable")]]
            left = left[label[left] != label[x]]
            own, size = np.sort(flat[ends[x] : ends[x + 1]]), int(ends[x + 1] - ends[x])
            while len(left):
                some, left = left[:64], left[64:]
                many = ends[some + 1] - ends[some]
                starts = np.cumsum(many) - many
                theirs = flat[np.repeat(ends[some] - starts, many) + np.arange(many.sum())]
                place = np.searchsorted(own, theirs)
                place[place == size] = 0
                shared = np.add.reduceat((own[place] == theirs).astype(np.int64), starts)
                for y in some[shared >= similarity * (size + many - shared) - 1e-9].tolist():
                    if label[y] != label[x]:
                        links.append((int(node[x]), int(node[y])))
                        label[label == label[y]] = label[x]
                left = left[label[left] != label[x]]
    return links


def across(shared: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float, piece: int = PIECE) -> DataFrame:
    """Links (a, b) between different components that share a band, by exact count; fewer of them than rows of the bands.

    ``shared`` is (key, node), ``labels`` (node, n, f1, f2, label), ``sets`` (node, shingles). Only bands in which components meet are
    gone through. Of each, what lies outside the component of the band's least node visits all rows: both are dealt into
    pieces and each pair of pieces is a cell, so a group of any size fits, and one that is a single component already costs nothing.
    """
    rows = shared.join(labels, "node")
    groups = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m"), F.min(F.struct("node", "label")).alias("main"))
    groups = groups.filter("low <> high").select("key", F.col("main.label").alias("main"), F.ceil(F.col("m") / piece).alias("hp"))
    placed = cut(rows.join(groups, "key").withColumn("visits", F.col("label") != F.col("main")).drop("main"))
    visitors = placed.groupBy("key").agg(F.ceil(F.count_if("visits") / piece).alias("vp"))
    h, v = F.pmod(F.xxhash64("node"), "hp"), F.pmod(F.xxhash64("node"), "vp")
    to = lambda i, j, home, visits: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), home.alias("home"), visits.alias("visits"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    asked = F.when(F.col("visits"), F.transform(up_to("hp"), lambda i: to(i, v, no, yes))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,home:boolean,visits:boolean>>"))
    at = F.when((F.col("hp") == 1) & (F.col("vp") == 1), F.array(to(zero, zero, yes, F.col("visits")))).otherwise(F.concat(F.transform(up_to("vp"), lambda j: to(h, j, yes, no)), asked))
    dealt = placed.join(visitors, "key").withColumn("to", F.explode(at))
    dealt = dealt.select(F.xxhash64("key", "to.i", "to.j").alias("cell"), "to.home", "to.visits", "node", "n", "f1", "f2", "label").join(sets, "node")
    dealt = dealt.select("cell", "home", "visits", "node", "n", "f1", "f2", "label", "shingles")

    def run(batches):
        for cell in cells(batches):
            if links := joined(cell, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, size: int = STAGE_WORDS, similarity: float = SIMILARITY, piece: int = PIECE) -> DataFrame:
    """doc_id and component_id of every row: texts whose shingle sets reach a Jaccard ``similarity`` are linked, by exact count.

    First every node is held against the least node it shares a band with (in bands of more than ``piece`` nodes, against STARS
    others as well), which joins most of a group of copies of any size at the cost of a pair a node. Then the nodes of a
    band that are not yet in one component are compared, all of them, in cells. So no link that a band shows is missed, and copies are never
    spelled out in pairs. Shingles are made again for the texts that share a band instead of being kept for all. No doc_id may be null.
    """
    made = cut(sketches(docs, size))
    distinct = cut(made.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "keys", "f1", "f2")]))
    members = distinct.select(F.explode("keys").alias("key"), "node")
    groups = members.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("m")).filter("m > 1")
    shared = cut(members.join(groups, "key"))
    names = ["node", "n", "f1", "f2"]
    met = cut(shared.select("node").distinct().join(distinct.select(*names, "least"), "node"))
    ids = met.select(F.col("least").alias("doc_id")).distinct()
    few = met.count() <= SENT_IDS
    again = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = cut(shingle_rows(again, size).groupBy("node").agg(F.first("shingles").alias("shingles")))

    def starred(pairs: DataFrame) -> DataFrame:
        """Links of each node with the least of its hubs. ``pairs`` is (node, hub)."""
        stars = pairs.filter("hub <> node").groupBy("node").agg(F.min("hub").alias("b")).withColumnRenamed("node", "a")
        stars = stars.join(met.select(*names).toDF("a", "n1", "f11", "f21"), "a").join(met.select(*names).toDF("b", "n2", "f12", "f22"), "b")
        return verified(stars.filter(fits("1", "2", similarity)).select("a", "b"), sets, similarity)

    edges = cut(starred(shared.select("node", "hub")))
    large = shared.filter(F.col("m") > piece).select("key", "node")
    for i in range(STARS if large.first() is not None else 0):
        hubs = large.groupBy("key").agg(F.min_by("node", F.xxhash64(F.lit(i), "node")).alias("hub"))
        edges = edges.union(cut(starred(large.join(hubs, "key").select("node", "hub"))))
    found = with_roots(cut(components(edges)))
    labels = cut(met.select(*names).join(found, "node", "left").select(*names, F.coalesce("root", "node").alias("label")))
    edges = edges.union(cut(across(shared.select("key", "node"), labels, sets, similarity, piece)))
    linked = cut(distinct.select("node", "least").join(with_roots(cut(components(edges))), "node"))
    moved = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    moved = moved.union(distinct.select("node", "least").join(linked, "node", "left_anti"))
    return made.select("doc_id", "node").join(moved, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The document with the least doc_id of each component of similar(), one row of it; a null doc_id stays.

    Of rows that repeat a kept doc_id the least by a hash of all its columns stays.
    """
    own, order = free(docs.columns, "_own", "_order")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    placed = cut(similar(docs.filter("doc_id is not null"), **options).groupBy("doc_id").agg(F.max("component_id").alias("most"), F.count("*").alias("m")).filter("most <> doc_id or m > 1"))
    gone, again = placed.filter("most <> doc_id").select("doc_id"), placed.filter("most = doc_id and m > 1").select("doc_id")
    sent = lambda ids: F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    stay = docs.withColumn(own, F.col("doc_id").cast("long")).join(sent(gone.toDF(own)), own, "left_anti")
    if again.first() is None:
        return stay.select(*columns)
    again = sent(again.toDF(own))
    once = stay.join(again, own, "left_semi").withColumn(order, row_hash(docs))
    once = once.groupBy(own).agg(F.min_by(F.struct(*columns), order).alias("r")).select("r.*")
    return stay.join(again, own, "left_anti").select(*columns).unionByName(once)
