import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, quality, toxicity
from tidemark.llm.base import held_out, table
from tidemark.llm.words import LETTERS, Shapes, numbered

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def data(spark):
    docs = table(spark, SF, "documents").cache()
    return docs, table(spark, SF, "labels")


def test_toxicity_held_out(data):
    docs, labels = data
    got = toxicity.toxicity(docs, labels)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    j = got.join(labels, "doc_id").filter("held_out")
    tp, fp, fn = j.agg(F.expr("count_if(predicted = 1 and toxic = 1)"), F.expr("count_if(predicted = 1 and toxic = 0)"), F.expr("count_if(predicted = 0 and toxic = 1)")).first()
    assert 2 * tp / (2 * tp + fp + fn) > 0.9
    assert got.filter("score < 0 or score > 1 or (score >= 0.3) <> (predicted = 1)").count() == 0


def test_toxicity_never_sees_held_out_labels(data):
    docs, labels = data
    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    small, few = docs.filter("doc_id % 6 = 0"), lambda x: x.filter("doc_id % 6 = 0")
    a, b = (toxicity.toxicity(small, few(x)).select("doc_id", "score") for x in (labels, flipped))
    assert a.exceptAll(b).count() == 0


def labelled(spark, held):
    rows = table(spark, SF, "documents").join(table(spark, SF, "labels"), "doc_id").filter(held_out() if held else ~held_out()).filter("length(text) <= 20000")
    return sorted((r["text"], r["toxic"], r["lang"]) for r in rows.collect())


def test_training_goes_beyond_its_warm_up(spark, monkeypatch):
    train, test = labelled(spark, False), labelled(spark, True)
    y, truth = np.array([r[1] for r in train], float), np.array([r[1] for r in test]) == 1

    def f1():
        net = toxicity.learn([r[0] for r in train], y, [r[2] for r in train], y.mean())
        found = net.probability(*net.answers(pa.array([r[0] for r in test]))) >= toxicity.THRESHOLD
        return 2 * (found & truth).sum() / (found.sum() + truth.sum())

    trained = f1()
    monkeypatch.setattr(toxicity.ConvNet, "epoch", lambda *a: None)
    assert trained > 0.9 and trained > f1() + 0.1


def plain_logit(net, text):
    """Word by word, filter by filter, place by place."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    vectors = [net.embed[toxicity.features([w])[0]].mean(axis=0) for w in words] + [np.zeros(toxicity.DIM)] * 3
    out, tap = net.prior[0], 0
    for j, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = max(sum(float(vectors[i + k] @ net.filters[tap + k][:, f]) for k in range(w)) for i in range(len(words) + 1))
            at = j * toxicity.FILTERS + f
            out += max(0.0, best + net.bias[at]) * net.out[at]
        tap += w
    return out


def test_the_network_against_its_plain_form():
    r = random.Random(3)
    texts = [" ".join("".join(r.choices("abcdéß", k=r.randrange(1, 12))) for _ in range(n)) for n in (1, 2, 3, 7, 40)] + ["One, two!", "", None]
    net = toxicity.ConvNet()
    net.train([t for t in texts if t], np.array([0, 1, 0, 1, 0, 1.0]), steps=5, size=4)
    net.bias += np.linspace(-1, 1, len(net.bias)).astype(np.float32)
    got = net.logits(*numbered(pa.array(texts), LETTERS))
    assert np.allclose(got, [plain_logit(net, t) for t in texts], atol=1e-3)


def plain_language(rows, texts):
    """Counts in dictionaries; each word on its own falls back to shorter and shorter n-grams."""
    langs = sorted({x for _, x in rows})
    tables = {n: Counter() for n in range(6)}
    split = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    grams = lambda w, n: [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)] if n else [w]
    for text, lang in rows:
        for w in split(text):
            for n in range(6):
                for g in grams(w, n):
                    tables[n][g, lang] += 1
    logs = {}
    for n, t in tables.items():
        keys = sorted({g for g, _ in t})
        total = [sum(t[g, x] for g in keys) for x in langs]
        for g in keys:
            if sum(t[g, x] for x in langs) >= 2:
                v = np.array([np.log((t[g, x] + 0.5) / (total[k] + 0.5 * len(keys) + 1)) for k, x in enumerate(langs)])
                logs[n, g] = v - v.max()
    out = []
    for text in texts:
        score, words = np.zeros(len(langs)), split(text)
        for w in words:
            for n in (0, 5, 4, 3, 2, 1):
                if known := [logs[n, g] for g in grams(w, n) if (n, g) in logs]:
                    score += sum(known) / len(known)
                    break
        share = np.exp(score - score.max())
        out.append((langs[int(score.argmax())], share.max() / share.sum()) if words else ("und", 0.0))
    return out


def test_language_against_plain_counts(spark):
    docs = [(r["text"], r["lang"]) for r in table(spark, "/root/testdata/sf0.01", "documents").filter("lang is not null and length(text) < 1500").orderBy("doc_id").collect()]
    train, texts = docs[:120], [t for t, _ in docs[120:200]] + ["xyzzy qwrt", "é", "12 ?!", "", None]
    langs, share = langid.BackoffModel.fit(train).predict(pa.array(texts))
    want = plain_language(train, texts)
    assert langs == [x for x, _ in want]
    assert np.allclose(share, [p for _, p in want], atol=1e-3)


def test_grades_against_the_plain_formula(spark):
    r = random.Random(5)
    texts = [" ".join(r.choices(["Good", "good,", "BAD!!!", "x9", "a-b", "...", "9:30", "Ünd"], k=r.randrange(1, 60))) for _ in range(60)]
    grades = [min(2, t.count("!!!") // 3) for t in texts]
    model = quality.OrdinalModel([0, 1, 2]).fit(texts, grades, np.ones(60))
    some = [*texts, "", None]
    got = {x["doc_id"]: x for x in quality.grade(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), model, tail=1).collect()}
    cuts = model.thresholds
    assert list(cuts) == sorted(cuts)
    for i, t in enumerate(some):
        tokens = (t or "").split()
        x = sum(model.weights[j] * v for j, v in quality.whole(tokens))
        for w in tokens:
            a, b = quality.token(w)
            x += (quality.WORD * model.weights[a] + quality.SHAPE * model.weights[b]) / len(tokens)
        up_to = [1 / (1 + np.exp(-(c - x))) for c in cuts] + [1.0]
        expected = sum(g * (p - q) for g, p, q in zip((0, 1, 2), up_to, [0.0, *up_to], strict=False))
        assert abs(got[i]["expected_grade"] - expected) < 1e-5 and abs(got[i]["tail_prob"] - (1 - up_to[0])) < 1e-5


def test_blocks_give_what_one_piece_gives():
    net = toxicity.ConvNet()
    texts = numbered(pa.array([" ".join("abcdefgh"[i % 7] * (i % 13 + 1) for i in range(5000)), "", None, "one"]), LETTERS)
    whole = net.logits(*texts)
    old, toxicity.BLOCK = toxicity.BLOCK, 64
    try:
        parts = net.logits(*texts)
    finally:
        toxicity.BLOCK = old
    assert np.allclose(whole, parts, atol=1e-5)


def test_hashes_of_words_and_grams():
    words = ["", "a", "ab", "abc", "ab"]
    s = Shapes(words)
    whole = s.whole()
    assert whole[2] == whole[4] and len(set(whole.tolist())) == 4
    owner, h = s.grams(4)
    assert owner.tolist() == [2, 3, 3, 4] and h[0] == h[3] and len(set(h.tolist())) == 3
    assert [sorted(np.bincount(s.grams(3)[0], minlength=5).tolist())] == [[0, 1, 2, 2, 3]]


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x", 1), (2, "", None, 2), (None, "a b", "y", 3)], "doc_id long, text string, lang string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.toxicity(docs, none).collect()] == [0.0] * 3
    assert toxicity.toxicity(docs.filter("false"), none).count() == 0


def test_language_held_out(data):
    docs = data[0]
    got = langid.language_id(docs)
    right, n = got.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.expr("count_if(lang = lang_pred)"), F.count("*")).first()
    assert right / n > 0.97


def test_backoff_goes_from_words_to_shorter_grams():
    m = langid.BackoffModel.fit([("the thing the thing", "en"), ("das ding das ding", "de")])
    assert m.langs == ["de", "en"]
    rows = m.rows(["the", "thingy", "dingen", ""])
    assert rows.argmax(axis=1).tolist()[:3] == [1, 1, 0] and not rows[3].any()
    grams = {n: v[0] for n, v in m.tables.items()}
    assert len(grams[0]) == 4
    own = Shapes(["thingy"])
    known = [h for h in own.grams(5)[1] if h in set(grams[5].tolist())]
    logs = m.tables[5][1][np.searchsorted(grams[5], known)]
    assert np.allclose(rows[1], logs.mean(axis=0))


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, "das ding", "de", 1), (3, "the thing", "en", 2), (5, None, "en", 3), (7, " 123 !", None, 4), (9, "the " * 50_000, None, 5)], "doc_id long, text string, lang string, lang_pred int")
    rows = spark.createDataFrame([(i, t, g, 0) for i in range(20, 60) for t, g in (("das ding", "de"), ("the thing", "en"))], docs.schema)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.language_id(docs.union(rows)).filter("doc_id < 10").collect()}
    assert got[5] == got[7] == ("und", 0.0) and got[1][0] == "de" and got[9][0] == "en"
    empty = langid.language_id(docs.filter("false"))
    assert empty.count() == 0
    assert {r["lang_pred"] for r in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality_held_out(data):
    docs, labels = data
    got = quality.quality(docs, labels).join(labels, "doc_id").filter("held_out")
    right, n = got.agg(F.expr("count_if(accepted = (quality = 1))"), F.count("*")).first()
    assert right / n > 0.97


def test_quality_orders_three_grades(spark):
    kinds = {0: "BUY NOW!! BUY NOW!! ", 1: "some words and more, BUY NOW!! ", 2: "plain words in a plain order. "}
    rows = [(i * 3 + g, kinds[g] * (4 + i % 5) + f"w{i}") for i in range(80) for g in kinds]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 3) for d, _ in rows], "doc_id long, quality int")
    m = quality.fit(docs, labels)
    assert len(m.thresholds) == 2 and m.thresholds[0] < m.thresholds[1]
    got = quality.grade(docs, m).groupBy(F.col("doc_id") % 3).agg(F.avg("expected_grade"), F.avg("tail_prob")).orderBy("(doc_id % 3)").collect()
    assert got[0][1] < got[1][1] < got[2][1] and got[0][2] < got[2][2]


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 8), (2, "", 8), (None, "a", 9)], "doc_id long, text string, tail int")
    labels = spark.createDataFrame([(2, None), (2, 3), (9, 3)], "doc_id long, quality int")
    one = quality.grade(docs, quality.fit(docs, labels)).collect()
    assert [(r["expected_grade"], r["accepted"]) for r in one] == [(3.0, True)] * 4
    none = quality.grade(docs, quality.fit(docs, labels.filter("false"))).collect()
    assert all(r["expected_grade"] is None and r["accepted"] for r in none) and len(none) == 4
