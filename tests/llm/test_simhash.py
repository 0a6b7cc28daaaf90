import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, fps, radius=2):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(list(zip(ids, fps, strict=True)), 2):
        if (a ^ b).bit_count() <= radius:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint_matches_the_plain_form():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 3000):
        text = " ".join(r.choice(["Ab", "c", "É", "d-e", "ÄB", "x y"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == 0 == simhash.fingerprint(b" \t\n")


def test_query_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(docs).collect()}
    rows = [(r[0], plain_fingerprint(r[1])) for r in docs.collect()]
    want = components([r[0] for r in rows], [r[1] for r in rows])
    assert got == {i: (f"{fp:016x}", want[i]) for i, fp in rows}


def test_links_are_exact_for_planted_neighbours(spark):
    r = random.Random(2)
    fps = []
    for _ in range(300):
        fp = r.getrandbits(64)
        fps += [fp, fp ^ (1 << r.randrange(64)), fp ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)), fp ^ 0b111 << r.randrange(60)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for parts, cell_rows in ((2, 10**6), (4, 10**6), (8, 10**6), (4, 25), (2, 100)):
        got = {x[0]: x[1] for x in simhash.components(simhash.links(df, 2, parts, cell_rows)).collect()}
        want = components([int(np.uint64(f).view(np.int64)) for f in fps], fps)
        same = {}
        for i, root in want.items():
            same.setdefault(root, set()).add(got.get(i, i))
        assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)


def test_a_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r[0]: r[1] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_an_unfinished_contraction_is_an_error(spark):
    edges = spark.createDataFrame([(i * 7919 % 3000, (i + 1) * 7919 % 3000) for i in range(2999)], "a long, b long")
    with pytest.raises(RuntimeError, match="2 rounds"):
        simhash.components(edges, rounds=2)
    assert simhash.components(edges).select(F.countDistinct("root")).first()[0] == 1


def test_edge_cases(spark):
    same = "one two three four five"
    rows = [(5, same, 1), (3, same, 2), (3, same, 2), (9, None, 3), (8, "", 4), (None, same, 5), (None, "quite another text altogether", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r[0], r[2]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 8), (8, 8), (None, 3), (None, None)], key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0] is None, r[0] or 0) for r in kept.collect()) == [(False, 3), (False, 8), (True, 0), (True, 0)]
    assert simhash.near_duplicates(docs.filter("false")).count() == 0


def test_a_component_counts_its_root(spark):
    """Near copies whose least doc_id is that of the least fingerprint; odd words, white space and ids among them."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["É", "ünï", "\x1c", "a\x1db", "\x85", "\u2003x", "\0z", "AbC"]
    rows = []
    for _ in range(60):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 40, 400, 600]))]
        for _ in range(r.randint(1, 4)):
            text = list(base)
            text[r.randrange(len(text))] = r.choice(words)
            rows.append((r.randint(-(10**9), 10**9), r.choice([" ", "\t", "\x0b", "\r\n"]).join(text)))
    rows = list(dict(rows).items())
    fps = [plain_fingerprint(t) for _, t in rows]
    want = components([d for d, _ in rows], fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    near = [i for i in range(len(rows)) if any((fps[i] ^ f).bit_count() in (1, 2) for f in fps)]
    assert any(want[rows[i][0]] == rows[i][0] and signed[i] == min(signed[j] for j in near if want[rows[j][0]] == want[rows[i][0]]) for i in near)
    got = sorted(tuple(x) for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((d, f"{fp:016x}", want[d]) for (d, _), fp in zip(rows, fps, strict=True))


def test_one_large_group_makes_few_links(spark):
    base = 0x0123456789ABCDEF
    near = sorted({base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)} | {base})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in near], "fp long")
    links = simhash.links(df)
    assert links.count() < 25 * len(near)
    assert simhash.components(links).select(F.countDistinct("root")).first()[0] == 1


def jaccard_roots(texts):
    """The least id of each component of texts whose five-word shingle sets reach a Jaccard similarity of 0.8."""
    split = {i: (t or "").lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in split.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {find(i) for i in texts}


def test_keep_one_drops_edited_copies_and_no_others(spark):
    r = random.Random(8)
    texts = {}
    for i in range(0, 600, 4):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randrange(60, 400))]
        texts[i] = " ".join(words)
        for k, edits in ((1, 1), (2, len(words) // 50), (3, len(words) // 12)):
            copy = list(words)
            for at in r.sample(range(len(words)), edits):
                copy[at] = "edited"
            texts[i + k] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = jaccard_roots(texts)
    assert {x[0] for x in simhash.keep_one(docs).collect()} == want and 150 < len(want) < 450


def test_keep_one_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert {x[0] for x in simhash.keep_one(docs).collect()} == jaccard_roots({x[0]: x[1] for x in docs.collect()})


def test_shingle_sets_match_the_plain_form():
    texts = [None, "", " \t", "One", "a b c d", "a b c d e", "A B c D e", "x\ny  z é É w v u", "a b c d e f g a b c d e f g"]
    sets = simhash.shingle_sets(pa.array(["cut off", *texts]).slice(1))
    assert [len(x) for x in sets] == [0, 0, 0, 1, 1, 1, 1, 4, 7]
    assert sets[5].tolist() == sets[6].tolist()
    for s in sets:
        if len(s):
            (keys,) = simhash.band_keys([s])
            assert keys.tolist() == simhash.band_keys([sets[3], s])[1].tolist() and len(set(keys.tolist())) == simhash.BANDS


def test_small_pieces_find_the_same_copies(spark):
    r = random.Random(12)
    base = [f"w{r.randrange(3000)}" for _ in range(120)]
    texts = {}
    for i in range(90):  # some within reach of each other, some just out of it
        copy = list(base)
        for at in r.sample(range(120), 1 + i % 9):
            copy[at] = f"e{i}"
        texts[i] = " ".join(copy)
    for i in range(90, 99):
        texts[i] = " ".join([*base[:100], *(f"z{i}{k}" for k in range(20))]) if i % 2 else " ".join(f"q{i}{k}" for k in range(9))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = jaccard_roots(texts)
    for options in ({}, {"piece": 7}):
        assert {x[0] for x in simhash.keep_one(docs, **options).collect()} == want


def test_keep_one_keeps_columns_of_any_name_and_kind(spark):
    rows = [(1, "a b c d e f", 1, {"x": 1}), (2, "a b c d e f", 2, None), (2, "a b c d e f", 3, None), (7, "u v w x y z", 4, {}), (7, "u v w x y z", 4, {}), (None, "u v w x y z", 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _own int, node map<string,int>")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(((r[0], r[2]) for r in got.collect()), key=str) == [(1, 1), (7, 4), (None, 5)]
