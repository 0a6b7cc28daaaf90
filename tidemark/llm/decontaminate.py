"""Benchmark decontamination: word pairs find candidates, Smith-Waterman alignment decides.

A pair of text and item counts from an alignment of SCORE of the item's best and RAW points. With M words
matched and E substituted, inserted or left out, an alignment has M - E points and at most E + 1 runs of
matches, so at least M - E - 1 neighbouring words of the item stand side by side in the text as well. A
stretch of a text is a candidate when it holds that many of an item's word pairs within the length such an
alignment can have: a necessary condition, whatever else occurs in the corpus, so no alignment that counts
is missed. The words around a candidate are aligned with the item by Smith-Waterman with affine-free gaps.
The documents are read once: no text is shuffled.

An item of fewer than LEAST words, down to SHORTEST, has no room for such a condition: it counts where all its
words stand side by side in the text.

The item index is sent to all executors; its size is checked against ``max_words`` first, and a larger
benchmark is worked off in parts, each of them below that bound and one pass over the documents. A stretch of text whose seeds occur in
so many items that they would fill the memory is halved until they don't.

Edge cases: null and empty texts and items match nothing; an item of fewer words than ``shortest`` carries no
evidence (its words stand in most texts by chance) and is not searched for. Repeated documents and items each get
their rows. An empty benchmark or corpus gives no rows. Text of any length is worked off in overlapping blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import slices
from tidemark.llm.words import LETTERS_DIGITS, split_words

N, LEAST, SHORTEST, SCORE, RAW = 2, 8, 3, 0.4, 6.0
MATCH, MISMATCH, GAP = 1.0, -1.0, -1.0
MAX_WORDS = 2_000_000
BLOCK, EXPANDED = 200_000, 2_000_000  # words of a text, and occurrences of its seeds in items, held at a time


class ItemIndex:
    """Words of the items by number, and where each n-gram occurs in which item."""

    def __init__(self, items: list[tuple[int, str]], n: int = N, least: int = LEAST, shortest: int = SHORTEST):
        texts = split_words(pa.array([t for _, t in items], pa.string()), LETTERS_DIGITS).to_pylist()
        found = [(i, ws or []) for (i, _), ws in zip(items, texts, strict=True)]
        found = [(i, [w for w in ws if w]) for i, ws in found]
        self.items = [(i, w) for i, w in found if len(w) >= least]
        whole = [(i, w) for i, w in found if shortest <= len(w) < least]
        first = len(self.items)
        self.items += whole
        self.number = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        self.n, self.base = n, len(self.number) + 1
        if self.base**n >= 1 << 63:
            raise ValueError(f"runs of {n} of {self.base} words have no 63-bit numbers; give a smaller max_words")
        texts = [np.array([self.number[w] for w in ws], np.int64) for _, ws in self.items]
        self.texts, self.all_texts = texts[:first], texts
        #: items that count as a whole only, by their first word
        self.whole: dict[int, list[int]] = {}
        for i in range(first, len(texts)):
            self.whole.setdefault(int(texts[i][0]), []).append(i)
        self.openings = np.array(sorted(self.whole), np.int64)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        keys = [self.keys(t) for t in self.texts]
        self.seeds, place = np.unique(np.concatenate(keys) if keys else np.zeros(0, object), return_inverse=True)
        item = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        start = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.zeros(0, int)
        order = np.argsort(place, kind="stable")
        self.item, self.start = item[order], start[order]
        self.bounds = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=len(self.seeds))))).astype(int)

    def needs(self, score: float) -> np.ndarray:
        """The points from which an alignment with each item counts."""
        return np.maximum(RAW, score * MATCH * self.sizes)

    def keys(self, numbers: np.ndarray) -> np.ndarray:
        """One integer for each n-gram, or -1 where a word is in no item. Exact: base ** n stays below 2 ** 63."""
        m = len(numbers) - self.n + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        key, ok = np.zeros(m, np.int64), np.ones(m, bool)
        for k in range(self.n):
            part = numbers[k : k + m]
            key = key * self.base + part
            ok &= part > 0
        return np.where(ok, key, -1)

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a text that hold a seed, and the seeds."""
        keys = self.keys(numbers)
        at = np.flatnonzero(keys >= 0)
        if not len(at):
            return at, at
        seed = np.searchsorted(self.seeds, keys[at])
        seed[seed == len(self.seeds)] = 0
        same = self.seeds[seed] == keys[at]
        return at[same], seed[same]

    def exact(self, numbers: np.ndarray) -> list[tuple]:
        """(item, 1.0, first word, last word) of the first place of each short item that stands in the text as a whole."""
        out = []
        if not len(self.openings):
            return out
        at = np.flatnonzero(np.isin(numbers, self.openings))
        for w in np.unique(numbers[at]).tolist():
            here = at[numbers[at] == w]
            for i in self.whole[w]:
                item, left = self.all_texts[i], here[here <= len(numbers) - len(self.all_texts[i])]
                for k in range(1, len(item)):
                    left = left[numbers[left + k] == item[k]]
                if len(left):
                    out.append((i, 1.0, int(left[0]), int(left[0]) + len(item) - 1))
        return out

    def numbers(self, texts: pa.Array) -> list[np.ndarray]:
        """The item number of each word of each text, or 0."""
        split = split_words(texts, LETTERS_DIGITS)
        codes = pc.fill_null(pc.index_in(split.values, value_set=pa.array(list(self.number), pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ends = split.offsets.to_pylist()
        return [codes[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def local(item: np.ndarray, words: np.ndarray) -> tuple[float, int]:
    """The best local score of Smith-Waterman, and the text's word at which it is first reached.

    A row is computed at once: a run of gaps along the row is a running maximum.
    """
    m = len(words)
    steps = GAP * np.arange(m + 1)
    row, best = np.zeros(m + 1), (0.0, 0)
    now = np.zeros(m + 1)
    for w in item:
        np.maximum(row[:-1] + np.where(words == w, MATCH, MISMATCH), row[1:] + GAP, out=now[1:])
        row = np.maximum.accumulate(np.maximum(now, 0) - steps) + steps
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (float(row[j]), j - 1)
    return best


def align(item: np.ndarray, words: np.ndarray, least: float = 0.0) -> tuple[float, int, int]:
    """The best local score, and the first and last word of the text in it.

    The beginning is the end of the alignment read backwards; it isn't looked for below ``least``.
    """
    score, last = local(item, words)
    if score <= 0 or score < least:
        return score, 0, 0
    return score, last - local(item[::-1], words[last::-1])[1], last


def candidates(index: ItemIndex, numbers: np.ndarray, needs: np.ndarray):
    """(item, from, to): stretches of a text that may hold an alignment of ``needs`` points; all such alignments lie in one."""
    at, seed = index.hits(numbers)
    pairs = np.maximum(1, np.ceil(needs - 1e-9).astype(np.int64) - 1)
    if not len(at) or len(at) < pairs.min():
        return
    many = index.bounds[seed + 1] - index.bounds[seed]
    flat = np.repeat(index.bounds[seed] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    at, item = np.repeat(at, many), index.item[flat]
    order = np.lexsort((at, item))
    at, item = at[order], item[order]
    once = np.concatenate(([True], (np.diff(item) != 0) | (np.diff(at) != 0)))
    at, item = at[once], item[once]
    last = np.arange(len(at)) + pairs[item] - 1
    begin = np.flatnonzero(last < len(at))
    last = last[begin]
    # insertions cost a point each, so no more words of a text than this are in an alignment that counts
    span = (2 * index.sizes - needs).astype(np.int64)[item[begin]]
    near = (item[last] == item[begin]) & (at[last] - at[begin] <= span - index.n)
    begin, last, span = begin[near], last[near], span[near]
    low, high = at[last] + index.n - span, at[begin] + span
    cut = np.flatnonzero((np.diff(item[begin]) != 0) | (low[1:] > high[:-1])) + 1 if len(begin) else []
    for part in np.split(np.arange(len(begin)), cut) if len(begin) else ():
        yield int(item[begin[part[0]]]), max(0, int(low[part[0]])), int(high[part[-1]])


def blocks(index: ItemIndex, numbers: np.ndarray, reach: int, at: int = 0):
    """Overlapping blocks of a text: (offset, numbers). A block whose seeds occur more than EXPANDED times in items is halved."""
    if len(numbers) > BLOCK + reach:
        for b in range(0, len(numbers) - reach, BLOCK):
            yield from blocks(index, numbers[b : b + BLOCK + reach], reach, at + b)
        return
    _, seed = index.hits(numbers)
    if len(numbers) > 4 * reach and len(seed) and int((index.bounds[seed + 1] - index.bounds[seed]).sum()) > EXPANDED:
        half = (len(numbers) - reach) // 2
        yield from blocks(index, numbers[: half + reach], reach, at)
        yield from blocks(index, numbers[half:], reach, at + half)
        return
    yield at, numbers


def best_alignments(index: ItemIndex, numbers: np.ndarray, score: float = SCORE) -> list[tuple]:
    """(item, score, first word, last word) of the best alignment with each item that reaches ``score``."""
    needs = index.needs(score)
    best: dict[int, tuple] = {}
    reach = 4 * max(map(len, index.texts), default=0) + 64
    for offset, part in blocks(index, numbers, reach) if len(index.texts) else ():
        for i, a, b in candidates(index, part, needs):
            raw, s, e = align(index.texts[i], part[a:b], needs[i])
            got = raw / (MATCH * len(index.texts[i]))
            if raw >= needs[i] and got > best.get(i, (0, 0.0))[1]:
                best[i] = (i, got, offset + a + s, offset + a + e)
    return sorted([*best.values(), *index.exact(numbers)])


def item_parts(benchmark: DataFrame, max_words: int = MAX_WORDS):
    """The benchmark's items in lists of ``max_words`` words at most (or one item), read one after the other."""
    part, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        words = len(r[1]) // 2 + 1
        if part and size + words > max_words:
            yield part
            part, size = [], 0
        part.append((r[0], r[1]))
        size += words
    if part:
        yield part


def indexes(benchmark: DataFrame, least: int, shortest: int, max_words: int):
    """A broadcast index of each part of the benchmark that has items to search for."""
    sc = benchmark.sparkSession.sparkContext
    for items in item_parts(benchmark, max_words):
        index = ItemIndex(items, least=least, shortest=shortest)
        if index.items:
            yield sc.broadcast(index)


KINDS = {"doc_id": pa.int64(), "item_id": pa.int64(), "score": pa.float64(), "first_word": pa.int64(), "last_word": pa.int64()}
SCHEMA = "doc_id long, item_id long, score double, first_word long, last_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, score: float = SCORE, max_words: int = MAX_WORDS, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, item_id, score (share of the item's best score), first_word, last_word of each aligned pair.

    A row with a null doc_id has its pairs with a null doc_id.
    """
    found = None
    for shared in indexes(benchmark, least, shortest, max_words):

        def run(batches, shared=shared):
            index = shared.value
            for b in slices(batches):
                rows = [(d, index.items[i][0], s, x, y) for d, t in zip(b.column(0).to_pylist(), index.numbers(b.column(1)), strict=True) for i, s, x, y in best_alignments(index, t, score)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(KINDS.values())], names=list(KINDS))

        pairs = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
        found = pairs if found is None else found.union(pairs)
    return docs.sparkSession.createDataFrame([], SCHEMA) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, score: float = SCORE, max_words: int = MAX_WORDS, shortest: int = SHORTEST) -> DataFrame:
    """The rows whose text holds no test item, with all their columns, in one pass and without a shuffle. Each row is judged by its own text."""
    at = docs.columns.index("text")
    for shared in indexes(benchmark, least, shortest, max_words):

        def run(batches, shared=shared):
            index = shared.value
            for b in slices(batches):
                yield b.filter(pa.array([not best_alignments(index, t, score) for t in index.numbers(b.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


__all__ = ["ItemIndex", "align", "best_alignments", "clean", "contaminated"]
