import itertools
import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as dec
from tidemark.llm import linededup, mixing


def smith_waterman(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (1 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment_matches_the_plain_recursion():
    import numpy as np

    r = random.Random(3)
    for _ in range(200):
        a = [r.randrange(1, 5) for _ in range(r.randrange(1, 15))]
        b = [r.randrange(0, 5) for _ in range(r.randrange(1, 25))]
        score, s, e = dec.align(np.array(a), np.array(b))
        assert score == smith_waterman(a, b)
        if score:
            assert smith_waterman(a, b[s : e + 1]) == score


def words(r, n, size=4000):
    return [f"w{r.randrange(size)}" for _ in range(n)]


def test_planted_leaks_are_found_and_clean_texts_left(spark):
    r = random.Random(4)
    items = [words(r, r.randrange(12, 60)) for _ in range(40)]
    docs, want = [], set()
    for d in range(400):
        body = words(r, 300)
        kind = d % 8
        if kind < 4:
            i = r.randrange(40)
            t = list(items[i])
            if kind == 1:  # some words replaced
                t = [x if r.random() > 0.15 else "zz" for x in t]
            elif kind == 2:  # some words left out
                t = [x for x in t if r.random() > 0.12]
            elif kind == 3:  # words put between
                t = [y for x in t for y in ((x, "yy") if r.random() < 0.12 else (x,))]
            body[100:100] = t
            if kind == 0:
                body = [x.upper() + "," for x in body]
            if smith_waterman(items[i], t) >= max(6, 0.4 * len(items[i])):
                want.add((d, i))
        docs.append((d, " ".join(body)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(x[0], x[1]) for x in dec.contaminated(df, bench).collect()}
    assert len(want - got) <= len(want) * 0.02
    assert {d % 8 for d, _ in got - want} <= {0, 1, 2, 3}
    parts = {(x[0], x[1]) for x in dec.contaminated(df, bench, max_words=200).collect()}
    assert parts == got
    assert dec.clean(df, bench).filter("doc_id % 8 >= 4").count() == 200


def test_a_passage_in_every_document_is_found(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    df = spark.createDataFrame([(i, f"x{i} {item} y{i}") for i in range(50)], "doc_id long, text string")
    assert dec.contaminated(df, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 50


def test_edited_copies_of_a_frequent_passage_are_all_found(spark):
    r = random.Random(9)
    items = {i: words(r, n) for i, n in enumerate((15, 16, 18, 20, 25, 40))}
    docs, want = [], set()
    for d in range(600):
        i = d % 6
        change = r.choice((0.15, 0.2, 0.25, 0.3))
        # substitutions in one half, in the other words put in between, left out and substituted
        edit = (lambda x: ["zz"]) if d % 12 < 6 else (lambda x: r.choice(([x, "yy"], [], ["zz"])))
        t = [y for x in items[i] for y in (edit(x) if r.random() < change else [x])]
        if smith_waterman(items[i], t) >= max(6, 0.4 * len(items[i])):
            want.add((d, i))
        docs.append((d, " ".join(["before"] * 30 + t + ["after"] * 30)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    assert {(x[0], x[1]) for x in dec.contaminated(df, bench).collect()} == want and len(want) > 300


def test_decontamination_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "a b c d e f g h i", 3), (4, "a b c d e f g h i", 4), (4, "a b c d e f g h i", 4)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, "a b c d e f g h i")], "item_id long, text string")
    got = sorted(((r[0], r[1]) for r in dec.contaminated(df, bench).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4)], key=str)
    assert dec.contaminated(df, bench.filter("false")).count() == 0
    assert dec.contaminated(df.filter("false"), bench).count() == 0
    kept = dec.clean(df, bench)
    assert kept.columns == df.columns and sorted(r[0] for r in kept.collect()) == [1, 2]
    assert dec.clean(df, bench.filter("false")).count() == 5
    assert dec.split_words(pa.array([None, "", "A-b É1"]), dec.LETTERS_DIGITS).to_pylist()[2] == ["a", "b", "é1"]


def test_short_items_count_as_a_whole(spark):
    bench = spark.createDataFrame([(1, "who wrote the old book"), (2, "red green blue"), (3, "only two"), (4, "a a a b")], "item_id long, text string")
    texts = ["x Who wrote, the old book? y", "who wrote the very old book", "red green", "blue red green BLUE", "only two", "a a a a b", "who wrote the old book red green blue"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in dec.contaminated(df, bench).collect())
    assert got == [(0, 1, 1.0, 1, 5), (3, 2, 1.0, 1, 3), (5, 4, 1.0, 1, 4), (6, 1, 1.0, 0, 4), (6, 2, 1.0, 5, 7)]
    assert sorted(r[0] for r in dec.clean(df, bench).collect()) == [1, 2, 4]


def test_a_phrase_in_all_items_is_worked_off_in_bounded_parts():
    r = random.Random(11)
    phrase = words(r, 6)
    index = dec.ItemIndex([(i, " ".join(phrase + words(r, 14))) for i in range(300)])
    body = [w for _ in range(700) for w in (*phrase, *words(r, 4))] + list(index.items[5][1]) + words(r, 50)
    numbers = index.numbers(pa.array([" ".join(body)]))[0]
    want = dec.best_alignments(index, numbers)
    old, dec.EXPANDED = dec.EXPANDED, 20_000
    try:
        sizes = [len(x) for _, x in dec.blocks(index, numbers, 144)]
        assert len(sizes) > 10 and dec.best_alignments(index, numbers) == want
    finally:
        dec.EXPANDED = old
    assert any(i == 5 and score == 1.0 for i, score, *_ in want)


def test_more_words_than_keys_can_number_are_refused():
    with pytest.raises(ValueError, match="63-bit"):
        dec.ItemIndex([(1, " ".join(f"w{i}" for i in range(4000)))], n=6)


def test_blocks_cover_a_long_text(spark):
    r = random.Random(5)
    item = " ".join(words(r, 40))
    body = words(r, 3000)
    body[990:990] = item.split()
    old, dec.BLOCK = dec.BLOCK, 500
    try:
        index = dec.ItemIndex([(7, item)])
        got = dec.best_alignments(index, index.numbers(pa.array([" ".join(body)]))[0])
    finally:
        dec.BLOCK = old
    assert got == [(0, 1.0, 990, 1029)]


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_line_dedup_against_plain_counts(spark, sent):
    r = random.Random(6)
    lines = [f"line {i}" for i in range(30)]
    rows = [(i, r.choice(["a", "a", "b", None]), "\n".join(r.choices(lines, weights=range(1, 31), k=r.randrange(0, 8)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {x[0]: x[2] for x in linededup.drop_boilerplate(df, F.col("source"), "text", ratio=0.2, sent_bytes=sent).collect()}
    total, seen = Counter(s for _, s, _ in rows), Counter((s, x) for _, s, t in rows for x in set(t.split("\n")) if x)
    for i, s, t in rows:
        assert got[i] == "\n".join(x for x in t.split("\n") if not (x and seen[s, x] >= 5 and seen[s, x] >= 0.2 * total[s]))


def test_line_dedup_edge_cases(spark):
    names = "doc_id long, source string, text string, _host int, _bad int, _lines int, _here int, _HOST_ int, host int, k int, n int, m map<string,int>, n_dropped int"
    rows = [(i, "h", f" menu \nown {i}") for i in range(6)] + [(7, "h", None), (8, "h", "menu"), (8, "h", "menu"), (9, None, ""), (None, "i", "menu"), (10, "h", "x\n" * 100_000 + "menu")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7, 8, {"a": 1}, 99) for r in rows], names)
    done = linededup.drop_boilerplate(df, F.col("source"), "text")
    assert done.columns == df.columns
    got = {(r[0], r[1]): r for r in done.collect()}
    assert all(r[3:12] == (1, 2, 3, 4, 5, 6, 7, 8, {"a": 1}) for r in got.values()) and done.count() == 12
    short = {k: (r["text"], r["n_dropped"]) for k, r in got.items()}
    assert short[(0, "h")] == ("own 0", 1) and short[(7, "h")] == (None, 0) and short[(8, "h")] == ("", 1) and short[(9, None)] == ("", 0) and short[(None, "i")] == ("menu", 0)
    assert short[(10, "h")] == ("x\n" * 99_999 + "x", 1)
    assert linededup.drop_boilerplate(df.filter("false"), F.col("source"), "text").count() == 0


def test_page_lines(spark):
    html = "<html><head><title>T</title><script>a</script></head><body><nav>Home</nav><p>one <b>two</b></p><!-- x --><div>three</div></body></html>"
    pages = spark.createDataFrame([(i, f"http://u@Ex.com:8{i}/p", html.replace("three", f"three {i}")) for i in range(6)] + [(9, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["text"]) for r in linededup.page_lines(pages).collect()}
    assert got[3] == ("ex.com", "three 3") and got[9][0] is None


def plain_edf(weights, slots):
    """Every slot looks at all sources' next blocks."""
    total = sum(weights.values())
    done, out = dict.fromkeys(weights, 0), []
    for t in range(slots):
        ready = [(-(-(done[s] + 1) * total // w), done[s] * total // w, s) for s, w in weights.items() if done[s] * total // w <= t]
        out.append(min(ready)[2])
        done[out[-1]] += 1
    return out


def test_pfair_is_earliest_deadline_first_and_never_a_block_off():
    r = random.Random(7)
    for _ in range(20):
        weights = {f"s{i}": r.randrange(1, 60) for i in range(r.randrange(1, 9))}
        total = sum(weights.values())
        order = list(itertools.islice(mixing.schedule(weights), 3 * total))
        assert order == plain_edf(weights, 3 * total)
        seen = Counter()
        for t, s in enumerate(order, 1):
            seen[s] += 1
            assert all(abs(seen[x] * total - weights[x] * t) < total for x in weights)


@pytest.mark.parametrize("weights", [{"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, {"a": 0.6, "b": 0.39997, "c": 0.00003}, {"a": 2**0.5, "b": math.pi, "c": math.e, "d": 0.01}])
def test_a_million_slots_stay_within_a_block_of_the_targets(weights):
    total, seen = sum(weights.values()), Counter()
    for t, s in enumerate(itertools.islice(mixing.schedule(mixing.exact(weights)), 10**6), 1):
        seen[s] += 1
        if t % 97 == 0 or t > 999_000:
            assert all(abs(seen[x] - w / total * t) < 1 + 1e-6 for x, w in weights.items())


def plain_mix(sizes, weights, block):
    """(phase, source) of each slot, with all sources looked at in each slot."""
    left, out, phase = {s: -(-n // block) for s, n in sizes.items()}, [], 0
    while left:
        live = mixing.exact({s: weights[s] for s in left if weights.get(s)} or dict.fromkeys(left, 1.0))
        for s in plain_edf(live, sum(left.values())):
            out.append((phase, s))
            left[s] -= 1
            if not left[s]:
                del left[s]
                break
        phase += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1 / 3, "b": 0.7, "c": 0.01}, None])
def test_mix_against_the_plain_schedule(spark, weights):
    n = {"a": 900, "b": 300, "c": 130, None: 40}
    rows = [(i, s, f"t{i}") for i, s in enumerate(x for x, k in n.items() for _ in range(k))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, weights, block=8, bucket_rows=5).collect()
    assert sorted((r["doc_id"], r["source"], r["text"]) for r in got if r["source"]) == sorted(r for r in rows if r[1])
    assert len(got) == len(rows) and len({r["mix_position"] for r in got}) == len(rows)
    sizes = {s or mixing.NONE: k for s, k in n.items()}
    want = plain_mix(sizes, weights or {s: k**0.5 for s, k in sizes.items()}, 8)
    assert {(r["mix_slot"], r["mix_phase"], r["source"] or mixing.NONE) for r in got} == {(t, p, s) for t, (p, s) in enumerate(want)}
    filled = Counter(r["mix_slot"] for r in got)
    assert max(filled.values()) == 8 and sorted(k for k in filled.values() if k < 8) == sorted(k % 8 for k in n.values() if k % 8)
    assert all(r["mix_position"] // 8 == r["mix_slot"] for r in got)
    again = mixing.mix(df.repartition(7), weights, block=8, bucket_rows=5)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, got), key=str)


def test_blocks_grow_where_slots_would_be_too_many(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("source"))
    got = mixing.mix(df, block=8, max_slots=100).collect()
    assert len({r["mix_position"] for r in got}) == 5000 and 100 <= len({r["mix_slot"] for r in got}) <= 103


def test_many_sources(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 800).alias("source"))
    assert mixing.mix(df).select("mix_position").distinct().count() == 3000


def test_mix_edge_cases(spark):
    names = "doc_id long, source string, text string, _s int, _h int, _b int, _at int, _found int, s int, slot int, mix_slot int, m map<string,int>"
    row = lambda i, t, k: (i, "a", t, k, k, k, k, k, k, k, k, {"k": k})
    df = spark.createDataFrame([row(1, "x", 1), row(1, "x", 1), row(None, None, 2)], names)
    got = mixing.mix(df)
    assert got.columns == [c for c in df.columns if c != "mix_slot"] + ["mix_phase", "mix_slot", "mix_position"]
    assert sorted((r["_s"], r["slot"], r["m"]["k"], r["mix_slot"]) for r in got.collect()) == [(1, 1, 1, 0), (1, 1, 1, 0), (2, 2, 2, 0)]
    assert mixing.mix(df.filter("false")).count() == 0
