"""Toxicity: a convolutional text classifier, trained in numpy.

Words (runs of letters) become means of hashed embeddings (the word and its character n-grams); filters of one, two and
three words slide over them, the largest answer of each filter goes to a logistic output. A word's
part of each filter is computed once for each distinct word, so a text costs a few gathered additions
a word. All weights are learnt by gradient steps from random or zero values. As only the winners of the pooling have
gradients, the first embedding dimension is warmed up before: a logistic regression over the set of a text's buckets, with as many
steps on either class, which the first filter of each width then reads. Training goes on until the loss on a part of the
sample that is set aside has not fallen for PATIENCE epochs, and the best epoch counts. Thresholds are calibrated on that part for each language that
is recognised from the text itself (by a model that learns from the ``lang`` of the same training rows; no row's own ``lang`` is looked at when it is
scored), as means over resampled rows, drawn towards the common threshold where a language has few examples.

Edge cases: a null or empty text is scored as no words. Whole texts are read: a text of any length is
convolved in overlapping blocks. Labels that are null are ignored; a doc_id with several labels or
rows teaches with each. With one class or none to learn from, every score is 0.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import held_out, labelled_texts, slices
from tidemark.llm.langid import BackoffModel
from tidemark.llm.words import LETTERS, Shapes, numbered, summed

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 12, 8, (1, 2, 3)
BLOCK = 100_000
TAPS = [(w, k) for w in WIDTHS for k in range(w)]
THRESHOLD = 0.3
GRAMS = (5, 7)
EPOCHS, PATIENCE, WARM, RESAMPLED, FEW = 12, 3, 6, 40, 10


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, starts): the buckets of each word and of its n-grams of GRAMS characters, words in order."""
    shapes = Shapes(words)
    owner, hashes = np.arange(len(words)), shapes.whole()
    for n in GRAMS:
        more, h = shapes.grams(n)
        owner, hashes = np.concatenate((owner, more)), np.concatenate((hashes, h))
    order = np.argsort(owner, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])).astype(np.int64)
    return (hashes[order] % np.uint64(BUCKETS)).astype(np.int64), starts


def pooled(taps: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The largest answer of each filter from each start to the next.

    A filter is worked off at a time, on plain vectors. ``taps`` has a row for each tap and filter.
    """
    out, col = np.empty((len(starts), FILTERS * len(WIDTHS)), np.float32), 0
    for j, w in enumerate(WIDTHS):
        for f in range(FILTERS):
            h = taps[col + f][ids]
            for k in range(1, w):
                h[:-k] += taps[col + k * FILTERS + f][ids[k:]]
            out[:, j * FILTERS + f] = np.maximum.reduceat(h, starts)
        col += w * FILTERS
    return out


class ConvNet:
    """Embeddings, filters and output weights; ``shift`` holds the calibrated threshold by language."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
        self.filters = r.normal(0, 0.4, (len(TAPS), DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = r.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.prior = np.zeros(1, np.float32)
        self.shift: dict[str, float] = {}
        self.slope, self.fitted = 1.0, False
        self.langs: BackoffModel | None = None

    def rows(self, words: list[str]) -> np.ndarray:
        """What each word adds to each filter at each tap (words in columns); the first word is the empty one and adds nothing."""
        flat, starts = features(words)
        sizes = np.diff(np.append(starts, len(flat)))
        means = np.stack([np.add.reduceat(np.ascontiguousarray(self.embed[:, d])[flat], starts) for d in range(DIM)]) / sizes
        out = np.concatenate(list(self.filters), axis=1).T.astype(np.float32) @ means.astype(np.float32)
        out[:, 0] = 0
        return np.ascontiguousarray(out)

    def logits(self, ids: np.ndarray, ends: np.ndarray, words: list[str]) -> np.ndarray:
        """The output of each text before the logistic function; texts as numbered() gives them."""
        taps = self.rows(words)
        pieces, owner = [], []  # (ids, positions that count): a block reads on into the next for its last positions
        for i, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist(), strict=False)):
            for at in range(a, max(b, a + 1), BLOCK):
                last = at + BLOCK >= b
                pieces.append((np.concatenate((ids[at:b], [0] * max(WIDTHS))), b - at + 1) if last else (ids[at : at + BLOCK + max(WIDTHS) - 1], BLOCK))
                owner.append(i)
        best = np.full((len(ends) - 1, len(self.bias)), -np.inf, np.float32)
        todo, size = [], 0
        for i, (p, _) in enumerate(pieces):
            todo.append(i)
            size += len(p)
            if size >= BLOCK or i == len(pieces) - 1:
                starts = np.concatenate(([0], np.cumsum([len(pieces[j][0]) for j in todo])[:-1])).astype(int)
                cuts = np.stack((starts, starts + [pieces[j][1] for j in todo]), axis=1).ravel()
                got = pooled(taps, np.concatenate([*(pieces[j][0] for j in todo), [0]]), cuts)
                np.maximum.at(best, [owner[j] for j in todo], got[::2])
                todo, size = [], 0
        return np.maximum(best + self.bias, 0) @ self.out + self.prior[0]

    def train(self, texts: list[str], labels: np.ndarray, aside: tuple[list[str], np.ndarray] | None = None, epochs: int = EPOCHS, steps: int = 300, size: int = 32, rate: float = 0.05, seed: int = 7) -> None:
        """Adagrad on the logistic loss; only the positions that win the pooling have gradients. Few texts are gone through more often."""
        ids, ends, names = numbered(pa.array(texts, pa.string()), LETTERS)
        docs = [np.concatenate((ids[a:b], [0] * max(WIDTHS))) for a, b in zip(ends, ends[1:], strict=False)]
        flat, starts = features(names)
        feats = np.split(flat, starts[1:])
        self.warm_up(docs, feats, labels)
        params = [self.embed, self.filters, self.bias, self.out, self.prior]
        past = [np.full_like(p, 1e-6) for p in params]
        r, best, since = np.random.default_rng(seed), (np.inf, []), 0
        for _ in range(max(epochs, -(-steps * size // max(len(docs), 1)))):
            self.epoch(docs, feats, labels, params, past, r, size, rate)
            if aside is None:
                continue
            loss = self.loss(*aside)
            if loss < best[0]:
                best, since = (loss, [p.copy() for p in params]), 0
            elif (since := since + 1) >= PATIENCE:
                break
        for p, kept in zip(params, best[1], strict=False):
            p[...] = kept

    def loss(self, texts: list[str], labels: np.ndarray) -> float:
        """The mean logistic loss, either class counting a half."""
        z = np.clip(self.logits(*numbered(pa.array(texts, pa.string()), LETTERS)), -30, 30)
        each = np.log1p(np.exp(np.where(labels == 1, -z, z)))
        return float(each[labels == 1].mean() + each[labels == 0].mean())

    def epoch(self, docs: list[np.ndarray], feats: list[np.ndarray], labels: np.ndarray, params: list[np.ndarray], past: list[np.ndarray], r: np.random.Generator, size: int, rate: float) -> None:
        """One pass over the texts in a random order."""
        nf = FILTERS
        order = r.permutation(len(docs))
        for at in range(0, len(order), size):
            chosen = order[at : at + size]
            ids = np.concatenate([docs[i] for i in chosen])
            used, local = np.unique(ids, return_inverse=True)
            mine = [feats[u] for u in used if u]
            counts = np.array([len(f) for f in mine])
            zero = int(used[0] == 0)
            if not mine:
                continue
            flat = np.concatenate(mine)
            v = np.zeros((len(used), DIM), np.float32)
            v[zero:] = np.add.reduceat(self.embed[flat], np.concatenate(([0], np.cumsum(counts)[:-1])), axis=0) / counts[:, None]
            bounds = np.concatenate(([0], np.cumsum([len(docs[i]) for i in chosen])))
            taps = [v @ f for f in self.filters]
            top = np.empty((len(chosen), len(self.bias)), np.float32)
            win = np.empty((len(chosen), len(self.bias)), np.int64)
            col = 0
            for j, w in enumerate(WIDTHS):
                h = taps[col][local]
                for k in range(1, w):
                    h[:-k] += taps[col + k][local[k:]]
                for d in range(len(chosen)):
                    part = h[bounds[d] : bounds[d + 1] - max(WIDTHS) + 1]  # no filter reads on into the next text
                    win[d, j * nf : (j + 1) * nf] = part.argmax(0) + bounds[d]
                    top[d, j * nf : (j + 1) * nf] = part.max(0)
                col += w
            act = np.maximum(top + self.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ self.out + self.prior, -30, 30)))
            g = ((p - labels[chosen]) / len(chosen)).astype(np.float32)
            inner = g[:, None] * self.out * (act > 0)
            grads = [None, np.zeros_like(self.filters), inner.sum(0), act.T @ g, g.sum(keepdims=True)]
            gv, col = np.zeros_like(v), 0
            padded = np.concatenate((local, [0, 0]))
            for j, w in enumerate(WIDTHS):
                gi = inner[:, j * nf : (j + 1) * nf]
                for k in range(w):
                    u = padded[win[:, j * nf : (j + 1) * nf] + k]
                    grads[1][col + k] = np.einsum("dfe,df->ef", v[u], gi)
                    np.add.at(gv, u.ravel(), (gi[:, :, None] * self.filters[col + k].T[None]).reshape(-1, DIM))
                col += w
            won = np.flatnonzero(gv[zero:].any(axis=1))
            if not len(won):
                continue
            rows, place = np.unique(np.concatenate([mine[i] for i in won]), return_inverse=True)
            ge = np.zeros((len(rows), DIM), np.float32)
            np.add.at(ge, place, np.repeat(gv[zero:][won] / counts[won, None], counts[won], axis=0))
            past[0][rows] += ge * ge
            self.embed[rows] -= rate * ge / np.sqrt(past[0][rows])
            for q, h, d in zip(params[1:], past[1:], grads[1:], strict=True):
                h += d * d
                q -= rate * d / np.sqrt(h)

    def warm_up(self, docs: list[np.ndarray], feats: list[np.ndarray], labels: np.ndarray, rate: float = 0.1, decay: float = 1e-3, seed: int = 1) -> None:
        """The first dimension by logistic regression over the buckets of each text, from zero, a text of either class in turn.

        The first filter of each width begins by reading that dimension at its first tap.
        """
        sets = []
        for ids in docs:
            used = [feats[i] for i in np.unique(ids) if i]
            sets.append(np.unique(np.concatenate(used)) if used else np.zeros(0, np.int64))
        weight, past, bias, r = np.zeros(BUCKETS), np.full(BUCKETS, 1e-4), 0.0, np.random.default_rng(seed)
        classes = [np.flatnonzero(labels == y) for y in (0, 1)]
        most = max(map(len, classes))
        for _ in range(WARM if min(map(len, classes)) else 0):
            turns = [np.concatenate((r.permutation(c), r.choice(c, most - len(c)))) for c in classes]
            for i in np.stack(turns, axis=1).ravel().tolist():
                own = sets[i]
                scale = 3 * max(1, len(own)) ** -0.5
                g = 1 / (1 + np.exp(-np.clip(scale * weight[own].sum() + bias, -30, 30))) - labels[i]
                step = g * scale + decay * weight[own]
                past[own] += step * step
                weight[own] -= rate * step / np.sqrt(past[own])
                bias -= 0.01 * g
        self.embed[:, 0] = weight
        self.filters[:, 0, 0] = 0
        for j in (0, 1, 3):
            self.filters[j, :, 0] *= 0.1
            self.filters[j, 0, 0] = 1
        self.out[:: FILTERS] = 1.0
        self.prior[0] = -2.0

    def calibrate(self, texts: list[str], labels: np.ndarray, share: float, least: int = 4) -> None:
        """For each recognised language the logit that parts the classes best, by F1 at the true share of label 1."""
        z, langs = self.answers(pa.array(texts, pa.string()))
        seen = np.array(langs)
        weight = np.where(labels == 1, share / max(labels.mean(), 1e-9), (1 - share) / max(1 - labels.mean(), 1e-9))

        r = np.random.default_rng(11)

        def parting(rows: np.ndarray) -> float:
            order = np.argsort(-z[rows], kind="stable")
            zs, ys, ws = z[rows][order], labels[rows][order], weight[rows][order]
            hit, miss = np.cumsum(ws * ys), np.cumsum(ws * (1 - ys))
            f1 = 2 * hit / (hit + miss + (ws * ys).sum())
            i = int(np.argmax(f1 >= f1.max() - 1e-9))
            return float((zs[i] + zs[min(i + 1, len(zs) - 1)]) / 2)

        def resampled(rows: np.ndarray) -> float:
            drawn = (np.concatenate([r.choice(c, len(c)) for y in (0, 1) if len(c := rows[labels[rows] == y])]) for _ in range(RESAMPLED))
            return float(np.mean([parting(rows), *map(parting, drawn)]))

        common = self.shift[""] = resampled(np.arange(len(z)))
        for name in sorted(set(seen)):
            rows = np.flatnonzero(seen == name)
            if (few := min(labels[rows].sum(), (1 - labels[rows]).sum())) >= least:
                self.shift[str(name)] = float((few * resampled(rows) + FEW * common) / (few + FEW))
        self.fitted = True

    def answers(self, texts: pa.Array) -> tuple[np.ndarray, list[str]]:
        """(logit, recognised language) of each text."""
        ids, ends, words = numbered(texts, LETTERS)
        totals = summed(self.langs.rows(words), ids, ends) if self.langs.langs else np.zeros((len(ends) - 1, 0))
        return self.logits(ids, ends, words), self.langs.answers(totals, np.ones(len(totals), bool))[0]

    def probability(self, z: np.ndarray, langs: list[str]) -> np.ndarray:
        """Scores in which a language's own threshold stands at THRESHOLD."""
        part = np.array([self.shift.get(x, self.shift.get("", 0.0)) for x in langs])
        y = self.slope * (z - part) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(y, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1600, max_chars: int = 20_000) -> ConvNet:
    """Train on at most about ``per_class`` documents of each label (a documented, hash-drawn bound).

    ``docs`` and ``labels`` must hold the rows to learn from only. A quarter of the sample calibrates.
    """
    rows, sizes = labelled_texts(docs, labels.filter("toxic in (0, 1)"), "toxic", per_class, max_chars)
    net = ConvNet()
    if len({r[1] for r in rows}) < 2:
        return net
    return learn([r[0] for r in rows], np.array([r[1] for r in rows], np.float64), [r[2] for r in rows], sizes[1] / (sizes[0] + sizes[1]))


def learn(texts: list[str], y: np.ndarray, langs: list, share: float) -> ConvNet:
    """Train on three quarters of the texts and calibrate on the others; ``share`` is the true share of label 1."""
    net = ConvNet()
    net.langs = BackoffModel.fit([(t, x) for t, x in zip(texts, langs, strict=True) if x is not None])
    aside = np.array([crc32(t.encode("utf-8", "surrogatepass")) % 4 == 0 for t in texts])
    if min(y[~aside].sum(), (1 - y[~aside]).sum(), y[aside].sum(), (1 - y[aside]).sum()) < 1:
        aside[:] = False
    pick = lambda keep: ([t for t, k in zip(texts, keep, strict=True) if k], y[keep])
    net.train(*pick(~aside), aside=pick(aside) if aside.any() else None)
    net.calibrate(*(pick(aside) if aside.any() else (texts, y)), share=share)
    return net


def score(docs: DataFrame, net: ConvNet) -> DataFrame:
    """doc_id, held_out, score, predicted, lang_seen of every row, from its whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)

    def run(batches):
        m = shared.value
        for b in slices(batches, 1000):
            if m.fitted:
                z, seen = m.answers(b.column(2))
                p = m.probability(z, seen)
            else:
                seen, p = ["und"] * b.num_rows, np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(p.astype(np.float64)), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(seen, pa.string())],
                names=["doc_id", "held_out", "score", "predicted", "lang_seen"],
            )

    slim = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, lang_seen string")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled rows that aren't held out, then score every row."""
    return score(docs, fit(docs.filter(~held_out()), labels.filter(~held_out())))
