"""Language identification by word-first backoff.

Known words score by their log frequency in each language. An unseen word falls back to its character
n-grams, the longest length first, until one of them is known. Words and n-grams are looked up by 64-bit
hashes, all distinct words of a batch together.

Edge cases: a null text, or one without any letter, is ``und`` with score 0. Repeated rows are scored
alike. Without a single training row every text is ``und``. Ties go to the language that sorts first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import free, held_out, labelled_sample, slices
from tidemark.llm.words import LETTERS, Shapes, find, numbered, summed

LONGEST = 5


class BackoffModel:
    """Per-language log frequencies, by hash: of words (table 0) and of n-grams (table n)."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.tables = langs, tables

    @classmethod
    def fit(cls, rows, min_count: int = 2) -> BackoffModel:
        """rows: (text, language). Words and n-grams seen ``min_count`` times or more are kept."""
        rows = list(rows)
        langs = sorted({r[1] for r in rows})
        if not langs:
            return cls([], {})
        ids, ends, words = numbered(pa.array([r[0] for r in rows], pa.string()), LETTERS)
        lang = np.repeat(np.searchsorted(langs, [r[1] for r in rows]), np.diff(ends))
        counts = np.zeros((len(words), len(langs)))
        np.add.at(counts, (ids, lang), 1)
        counts[0] = 0
        shapes = Shapes(words)

        def logs(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(hashes, return_inverse=True)
            table = np.stack([np.bincount(place, counts[owner, k], len(keys)) for k in range(len(langs))], axis=1)
            kept = table.sum(axis=1) >= min_count
            made = np.log((table[kept] + 0.5) / (table.sum(axis=0) + 0.5 * len(keys) + 1))
            return keys[kept], (made - made.max(axis=1, keepdims=True)).astype(np.float32)

        tables = {0: logs(np.arange(len(words)), shapes.whole())}
        for n in range(LONGEST, 0, -1):
            tables[n] = logs(*shapes.grams(n))
        return cls(langs, tables)

    def rows(self, words: list[str]) -> np.ndarray:
        """For each word its log frequency in each language, less that of the likeliest one. An empty word has zeros."""
        shapes = Shapes(words)
        out = np.zeros((len(words), len(self.langs)), np.float32)
        keys, logs = self.tables[0]
        at = find(keys, shapes.whole())
        known = at >= 0
        out[known] = logs[at[known]]
        done = known | (shapes.sizes == 2)
        for n in range(LONGEST, 0, -1):
            if done.all():
                break
            owner, hashes = shapes.grams(n)
            todo = ~done[owner]
            owner, hashes = owner[todo], hashes[todo]
            at = find(self.tables[n][0], hashes)
            hit = at >= 0
            owner, at = owner[hit], at[hit]
            if len(owner):
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
                many = np.diff(np.append(cuts, len(owner)))
                out[owner[cuts]] = np.add.reduceat(self.tables[n][1][at], cuts, axis=0) / many[:, None]
                done[owner[cuts]] = True
        return out

    def answers(self, totals: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its share; ``letters`` says whether a text has any."""
        if not self.langs:
            return ["und"] * len(totals), np.zeros(len(totals))
        best = totals.argmax(axis=1)
        share = 1 / np.exp(totals - totals[np.arange(len(totals)), best][:, None]).sum(axis=1)
        return [self.langs[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters, share, 0.0)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        ids, ends, words = numbered(texts, LETTERS)
        totals = summed(self.rows(words), ids, ends) if self.langs else np.zeros((len(ends) - 1, 0))
        return self.answers(totals, summed((np.arange(len(words)) > 0)[:, None], ids, ends)[:, 0] > 0)


def fit(docs: DataFrame, per_lang: int = 1000, max_chars: int = 20_000) -> BackoffModel:
    """Fit on at most about ``per_lang`` documents of each language (a documented, hash-drawn bound)."""
    return BackoffModel.fit([(r[0], r[1]) for r in labelled_sample(docs, "lang", per_lang, max_chars)])


def identify(docs: DataFrame, model: BackoffModel, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred and score, from the whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(free(keep, "_text")[0]))

    def run(batches):
        for b in slices(batches):
            langs, share = shared.value.predict(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(share)], names=[*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return slim.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def language_id(docs: DataFrame, per_lang: int = 1000) -> DataFrame:
    """Fit on rows that aren't held out, then predict every row: doc_id, held_out, lang_pred, score."""
    train = docs.filter(~held_out() & F.col("doc_id").isNotNull())
    model = fit(train, per_lang)
    slim = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return identify(slim, model, ["doc_id", "held_out"])
