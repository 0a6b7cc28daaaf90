"""Each stage against a plain version of it, on the stage's own input."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_simhash import jaccard_roots
from tests.llm.test_text_stages import plain_mix
from tidemark.llm import decontaminate, mixing, quality
from tidemark.llm.base import WordRows, table


def test_stages_against_plain_versions(spark, sf_dir, tmp_path):
    docs, inputs = table(spark, sf_dir, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        inputs[name] = before, {r["doc_id"]: r for r in docs.collect()}
        assert set(columns) <= set(docs.columns)
        if name != "mix":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == list(inputs)

    before, after = inputs["quality"]
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    cache = WordRows(model.rows)
    kept = {d for d, r in before.items() if model.grade(model.scores(cache, [r["text"]]), 1)[1][0] >= 0.5}
    assert set(after) == kept and 0 < len(kept) < len(before)

    before, after = inputs["line_dedup"]
    pages = Counter(r["source"] for r in before.values())
    seen = Counter((r["source"], x) for r in before.values() for x in {y.strip(" ") for y in r["text"].split("\n")})
    for d, r in before.items():
        bad = lambda x, s=r["source"]: x.strip(" ") and seen[s, x.strip(" ")] >= 5 and 100 * seen[s, x.strip(" ")] >= pages[s]
        assert after[d]["text"] == "\n".join(x for x in r["text"].split("\n") if not bad(x))
        assert after[d]["n_chars"] == len(after[d]["text"])

    before, after = inputs["near_dedup"]
    assert set(after) == jaccard_roots({d: r["text"] for d, r in before.items()})

    before, after = inputs["decontaminate"]
    index = decontaminate.ItemIndex([(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()])
    for d, r in before.items():
        words = index.numbers(pa.array([r["text"]]))[0]
        best = max(decontaminate.local(t, words)[0] / len(t) for t in index.texts)
        assert (d in after) == (best < decontaminate.SCORE), (d, best)

    before, after = inputs["mix"]
    assert set(after) == set(before)
    sizes = Counter(r["source"] for r in before.values())
    want = plain_mix(sizes, {s: n**0.5 for s, n in sizes.items()}, mixing.BLOCK)
    assert {(r["mix_slot"], r["mix_phase"], r["source"]) for r in after.values()} == {(t, p, s) for t, (p, s) in enumerate(want)}
    assert len({r["mix_position"] for r in after.values()}) == len(after)


def stages(spark, docs, sf_dir, folder):
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


def test_stages_take_nulls_repeats_and_any_column_names(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    names = ["accepted", "tail_prob", "expected_grade", "n_dropped", "_host", "node", "component_id", "item_id", "_s", "slot"]
    good = [r["text"] for r in docs.join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id").orderBy("doc_id").limit(3).collect()]
    odd = [(900_001, None, None, None, None), (900_002, "", "en", None, 0), (None, good[0], "en", "s", 5), (None, None, None, None, None), (900_003, good[1], None, "s", None), (900_003, good[1], None, "s", None), (900_004, good[2] + " " + good[2] * 300, "en", "s", 1)]
    more = docs.unionByName(spark.createDataFrame(odd, docs.schema)).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    done = stages(spark, more, sf_dir, tmp_path / "odd")
    assert done.columns[: len(more.columns)] == more.columns
    rows = done.collect()
    assert all([r[n] for n in names] == list(range(len(names))) for r in rows)
    ids = Counter(r["doc_id"] for r in rows)
    assert ids[900_003] <= 1 and max(n for i, n in ids.items() if i is not None) == 1
    assert stages(spark, more.filter("false"), sf_dir, tmp_path / "none").count() == 0


def test_run_returns_the_last_stage(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "text", "mix_phase", "mix_slot", "mix_position"} <= set(got.columns) and got.count() > 100
    assert np.all([isinstance(f, tuple) and len(f) == 2 for f in corpus_pipeline.STAGES])
