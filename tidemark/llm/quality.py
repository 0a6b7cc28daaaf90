"""Quality: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds part them. A
document's grade has P(grade <= k) = logistic(threshold_k - weights . features), which gives the
expected grade and the probability of the top part of the scale.

Features are shares of a text's white-space tokens: the hashed word, its hashed shape (letter cases,
digits, runs of punctuation) and whether it repeats the token before it; and hashed buckets of the
text's length and of its share of distinct tokens.

Edge cases: a null or empty text has the feature of no tokens only. With one grade to learn from,
every document gets that grade and is accepted; with none, expected_grade is null and all are accepted.
Null grades are ignored; a doc_id with several grades teaches with each.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import WordRows, held_out, labelled_texts, slices

BUCKETS = 1 << 16
WORD, SHAPE = 1.0, 3.0  # scales of the two kinds of token features
UPPER, LOWER, DIGIT, EDGE = re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+"), re.compile(r"^\W+|\W+$")
RUNS = re.compile(r"(\W)\1+")


def bucket(kind: str, what: str) -> int:
    return crc32(f"{kind}:{what}".encode("utf-8", "surrogatepass")) % BUCKETS


def token(t: str) -> tuple[int, int]:
    """Buckets of a token's word and of its shape."""
    shape = DIGIT.sub("9", UPPER.sub("X", LOWER.sub("x", RUNS.sub(r"\1\1", t))))
    return bucket("w", EDGE.sub("", t).lower()), bucket("s", shape)


def whole(tokens: list[str]) -> list[tuple[int, float]]:
    """Features of the text as a whole."""
    n = len(tokens)
    if not n:
        return [(bucket("n", "none"), 1.0)]
    again = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / n
    return [
        (bucket("n", str(n.bit_length())), 1.0),
        (bucket("d", f"{n.bit_length() // 2},{int(10 * len(set(tokens)) / n)}"), 1.0),
        (bucket("r", "again"), SHAPE * again),
    ]


class OrdinalModel:
    """Shared weights and ordered thresholds; ``grades`` in rising order."""

    def __init__(self, grades: list):
        self.grades = sorted(grades)
        self.weights = np.zeros(BUCKETS, np.float64)
        self.first, self.gaps = -1.0, np.zeros(max(0, len(grades) - 2))

    @property
    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate(([0.0], np.cumsum(np.exp(self.gaps))))

    def fit(self, texts: list[str], grades: list, weights: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 1e-5, seed: int = 3) -> OrdinalModel:
        """Adagrad, a text at a time in a fixed random order, on the weighted negative log likelihood."""
        cache: dict[str, tuple[int, int]] = {}
        made = []
        for t in texts:
            tokens = t.split()
            pairs = [cache.get(x) or cache.setdefault(x, token(x)) for x in tokens]
            w = whole(tokens)
            idx = np.array([*(p[0] for p in pairs), *(p[1] for p in pairs), *(i for i, _ in w)], np.int64)
            val = np.concatenate([np.full(len(pairs), WORD / max(1, len(pairs))), np.full(len(pairs), SHAPE / max(1, len(pairs))), [v for _, v in w]])
            u, place = np.unique(idx, return_inverse=True)
            made.append((u, np.bincount(place, val, len(u))))
        level = np.searchsorted(self.grades, grades)
        past, past_t = np.full(BUCKETS, 1e-4), np.full(1 + len(self.gaps), 1e-4)
        r, top = np.random.default_rng(seed), len(self.grades) - 1
        for _ in range(epochs):
            for i in r.permutation(len(made)):
                idx, val = made[i]
                x, cuts, k = float(self.weights[idx] @ val), self.thresholds, level[i]
                hi = 1 / (1 + np.exp(-np.clip(cuts[k] - x, -35, 35))) if k < top else 1.0
                lo = 1 / (1 + np.exp(-np.clip(cuts[k - 1] - x, -35, 35))) if k else 0.0
                p, dhi, dlo = max(hi - lo, 1e-12), hi * (1 - hi), lo * (1 - lo)
                gx = weights[i] * (dhi - dlo) / p
                g = gx * val + decay * self.weights[idx]
                past[idx] += g * g
                self.weights[idx] -= rate * g / np.sqrt(past[idx])
                gc = np.zeros(top)
                if k < top:
                    gc[k] -= weights[i] * dhi / p
                if k:
                    gc[k - 1] += weights[i] * dlo / p
                gt = np.concatenate(([gc.sum()], [gc[j + 1 :].sum() * np.exp(self.gaps[j]) for j in range(len(self.gaps))]))
                past_t += gt * gt
                step = rate * gt / np.sqrt(past_t)
                self.first -= step[0]
                self.gaps = np.clip(self.gaps - step[1:], -20, 20)
        return self

    def rows(self, tokens: list[str]) -> np.ndarray:
        """What a token adds to a text's score, before the division by their number."""
        b = np.array([token(t) for t in tokens]).reshape(-1, 2)
        return (WORD * self.weights[b[:, 0]] + SHAPE * self.weights[b[:, 1]]).astype(np.float64)[:, None]

    def scores(self, cache: WordRows, texts: list) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            tokens = t.split() if t else []
            own = sum(self.weights[j] * v for j, v in whole(tokens))
            ids = cache.ids(tokens)
            out[i] = own + (cache.rows[ids, 0].sum() / len(tokens) if tokens else 0.0)
        return out

    def grade(self, scores: np.ndarray, tail: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the probability of grade index ``tail`` or above."""
        if len(self.grades) == 1:
            return np.full(len(scores), float(self.grades[0])), np.ones(len(scores))
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None] - scores[:, None], -60, 60)))
        p = np.diff(np.concatenate((np.zeros((len(scores), 1)), 1 - above, np.ones((len(scores), 1))), axis=1), axis=1)
        return p @ np.array(self.grades, np.float64), above[:, tail - 1]


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", per_grade: int = 2000, max_chars: int = 20_000) -> OrdinalModel | None:
    """Fit on at most about ``per_grade`` documents of each grade (a documented, hash-drawn bound).

    Grades that were drawn at unlike rates are weighted back to their true shares.
    """
    rows, sizes = labelled_texts(docs, labels, column, per_grade, max_chars)
    if not rows:
        return None
    grades = [r[1] for r in rows]
    model = OrdinalModel(sorted(set(grades)))
    if len(model.grades) > 1:
        drawn = {g: grades.count(g) for g in model.grades}
        total = sum(sizes[g] for g in model.grades)
        weight = {g: sizes[g] / total * len(grades) / drawn[g] for g in model.grades}
        model.fit([r[0] for r in rows], grades, np.array([weight[g] for g in grades]))
    return model


NAMES = ("expected_grade", "tail_prob", "accepted")


def grade(docs: DataFrame, model: OrdinalModel | None, least: float = 0.5, tail: int | None = None, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """All columns of ``docs`` with expected_grade, tail_prob and accepted, or what ``names`` calls them.

    tail_prob is P(grade >= grades[tail]); ``tail`` is the top grade unless given. Accepted are documents
    with tail_prob of ``least`` or more. Columns of ``docs`` that are called like the new ones are replaced.
    """
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, columns = docs.columns.index("text"), docs.columns
    n = (len(model.grades) - 1 if tail is None else tail) if model else 0

    def run(batches):
        m = shared.value
        cache = WordRows(m.rows) if m else None
        for b in slices(batches):
            if m:
                mean, p = m.grade(m.scores(cache, b.column(at).to_pylist()), n)
            else:
                mean, p = np.full(b.num_rows, np.nan), np.ones(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mean, from_pandas=True), pa.array(p), pa.array(p >= least)], names=[*columns, *names])

    kinds = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    return docs.mapInArrow(run, kinds)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled rows that aren't held out; doc_id, held_out, expected_grade, tail_prob, accepted of every row."""
    model = fit(docs.filter(~held_out()), labels.filter(~held_out()))
    graded = grade(docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text"), model)
    return graded.drop("text")
