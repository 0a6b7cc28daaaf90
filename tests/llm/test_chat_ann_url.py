import hashlib
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, chat, urlfilter

TURNS = "conv_id long, turn long, role string, text string"


def digests(spark, rows):
    return {r["conv_id"]: r for r in chat.digest(chat.format_turns(chat.canonical(spark.createDataFrame(rows, TURNS)))).collect()}


def test_round_trip_of_hostile_texts(spark):
    r = random.Random(1)
    bits = ["<|im_end|>\n", "<|im_start|>", "\\", "\\s", "\\m", "\\n", "<|", "|>", "<", "|", "\n", "assistant", "é", "😀", " ", "\r"]
    rows = [(c, t, r.choice(["user", "assistant", "a\nb", "<|x", "\\n"]), "".join(r.choices(bits, k=r.randrange(9)))) for c in range(60) for t in range(r.randrange(1, 7))]
    got = digests(spark, rows)
    for c in range(60):
        own = [x for x in rows if x[0] == c]
        loss = "".join(x[3] for x in own if x[2] == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in own).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_edge_cases(spark):
    got = digests(spark, [(1, 0, None, None), (1, 0, None, None), (None, 1, "assistant", "x"), (2, None, "user", "late"), (2, 0, "assistant", "")])
    assert got[1]["n_turns"] == 2 and got[None]["loss_chars"] == 1 and got[2]["loss_chars"] == 0
    empty = spark.createDataFrame([(1, None), (2, [])], "conv_id long, turns array<struct<role:string,text:string>>")
    assert [(r["n_turns"], r["formatted_chars"]) for r in chat.digest(chat.format_turns(empty)).collect()] == [(0, 0)] * 2
    assert digests(spark, []) == {}


def test_records_keep_their_turns_beside_other_fields(spark):
    message = {"role": "user", "content": "q"}
    cases = [
        ({"messages": []}, "messages_empty", []),
        ({"id": 7, "meta": {"a": [1, {"b": None}]}, "messages": [message]}, "messages", [("user", "q")]),
        ({"messages": [{**message, "name": "x", "n": 1}, {"role": "assistant", "content": None}]}, "messages", [("user", "q"), ("assistant", None)]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}, {"type": "text", "text": "b"}]}]}, "messages_parts", [("user", "ab")]),
        ({"messages": [message, {"role": "assistant", "content": [{"type": "text", "text": "a"}]}]}, "messages_mixed", [("user", "q"), ("assistant", "a")]),
        ({"prompt": {"text": "x"}, "response": "y"}, "unknown", None),
        ({"prompt": 5, "response": "y"}, "unknown", None),
        ({"prompt": None, "response": "y", "system": "s", "x,<y>`z: w": 1}, "system_prompt_response", [("system", "s"), ("user", None), ("assistant", "y")]),
        ({"prompt": "p", "response": "y", "messages": [message]}, "messages", [("user", "q")]),
        ({"a": {"b": {"prompt": "p", "response": "r"}}}, "unknown", None),
        ([message], "unknown", None),
        ({}, "unknown", None),
    ]
    rows = [(i, json.dumps(r), 1, 2, "old") for i, (r, _, _) in enumerate(cases)] + [(90, "no json", 1, 2, "old"), (91, None, 1, 2, "old"), (92, '{"prompt":"a","prompt":"b","response":"c"}', 1, 2, "old")]
    df = spark.createDataFrame(rows, "i int, record string, _paths int, _variant int, layout string")
    got = {r["i"]: r for r in chat.from_records(df).collect()}
    for i, (record, layout, turns) in enumerate(cases):
        assert got[i]["layout"] == layout, record
        assert (None if got[i]["turns"] is None else [tuple(t) for t in got[i]["turns"]]) == turns, record
    assert all(got[i]["layout"] == "unknown" and got[i]["turns"] is None and got[i]["_paths"] == 1 for i in (90, 91, 92))
    paths = df.filter("i = 1").select(chat.variant_paths(F.schema_of_variant(F.try_parse_json("record")))).first()[0]
    assert sorted(paths) == ["id:NUMBER", "messages[].content", "messages[].role", "meta.a[]:VARIANT"]


def test_long_conversations_take_time_in_proportion(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text <| "), "id").alias("text"))
    made = chat.canonical(df).cache()
    made.count()
    began = time.perf_counter()
    (got,) = chat.digest(chat.format_turns(made)).collect()
    assert time.perf_counter() - began < 10
    texts = [f"text <| {i}" for i in range(n)]
    loss = "".join(texts[1::2])
    assert (got["n_turns"], got["loss_chars"], got["loss_sha256"]) == (n, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_output_names_of_formats_are_replaced(spark):
    df = spark.createDataFrame([(1, [("user", "é😀"), ("assistant", "b")], "x", 5)], "conv_id long, turns array<struct<role:string,text:string>>, formatted string, _made int")
    (r,) = chat.format_turns(df).collect()
    assert r["_made"] == 5 and [r["formatted"][a:b] for a, b in r["loss_spans"]] == ["b"]


def test_layouts_of_records(spark):
    turns = [("user", "q"), ("assistant", "a")]
    records = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        "messages_text": {"messages": [{"text": "q", "role": "user"}, {"role": "assistant", "text": "a"}]},
        "conversations": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "prompt_response": {"response": "a", "prompt": "q"},
        "prompt_completion": {"prompt": "q", "completion": "a"},
        "instruction_output": {"instruction": "q", "output": "a"},
        "instruction_input_output": {"instruction": "q", "input": "", "output": "a"},
        "question_answer": {"question": "q", "answer": "a"},
        "system_prompt_response": {"system": "", "prompt": "q", "response": "a"},
    }
    rows = [(k, json.dumps(v)) for k, v in records.items()] + [("unknown", '{"x": 1}'), ("unknown", "no json"), ("unknown", None)]
    for r in chat.from_records(spark.createDataFrame(rows, "want string, record string")).collect():
        assert r["layout"] == r["want"]
        assert (r["turns"] is None) == (r["want"] == "unknown") and (r["turns"] is None or [tuple(t) for t in r["turns"]] == turns), r


def test_layouts_of_tables(spark):
    want = [("user", "q"), ("assistant", "a")]
    for df in (
        spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, content string"),
        spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "conv_id long, messages array<struct<role:string,content:string>>"),
        spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, response string"),
        spark.createDataFrame([(1, '{"prompt": "q", "response": "a"}')], "conv_id long, record string"),
    ):
        assert [tuple(t) for t in chat.canonical(df).first()["turns"]] == want
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([(1,)], "x int"))


def brute(ids, x, queries, k=20):
    out = {}
    for q in queries:
        own = x[np.flatnonzero(ids == q)[0]]
        s = np.where(ids == q, -np.inf, (x * own[None]).sum(axis=1))
        top = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[q] = [(int(ids[i]), float(s[i])) for i in top]
    return out


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = df.collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    want = brute(ids, x, ids[ids % 20 == 0].tolist())
    assert got.keys() == want.keys()
    hits = sum(len({a for a, _ in want[q]} & {v for _, v, _ in got[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    by_id = dict(zip(ids.tolist(), x, strict=True))
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found}
        assert all(abs(s - float(by_id[q] @ by_id[v])) < 1e-12 for _, v, s in found)


def test_lengths_differ_and_copies_tie(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 8)) * r.uniform(0.1, 5, (400, 1))
    x[50:250] = x[50]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in ann.search(df, F.col("vec_id") % 20 == 0, list_rows=20, part_rows=30, query_rows=3).orderBy("query_id", "rank").collect():
        got.setdefault(row[0], []).append((row[2], row[3]))
    want = brute(np.arange(400), x, range(0, 400, 20))
    hits = sum(len({a for a, _ in want[q]} & {a for a, _ in got[q]}) for q in want)
    assert hits / 400 >= 0.9
    assert [a for a, _ in got[60]] == [a for a, _ in want[60]]


def test_a_repeated_id_takes_one_place_of_a_list_part(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(41, 6)) * 0.05 + np.array([1.0, 0, 0, 0, 0, 0])
    x[1:3] *= 1.5  # the nearest of all
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1, x[1].tolist())] * 50 + [(2, (x[2] * (1 - n / 1000)).tolist()) for n in range(50)]
    stored = spark.createDataFrame([(0, i, v) for i, v in rows], "list int, vec_id long, v array<double>")
    asked = spark.createDataFrame([(0, q, x[q].tolist(), float("-inf")) for q in (0, 1, 20)], "list int, vec_id long, v array<double>, bound double")
    got = {}
    for row in ann.ranked(ann.visit(stored, asked, 20), 20).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
    assert sorted(got) == [0, 1, 20]
    for q, found in got.items():
        score = {}
        for i, v in rows:
            if i != q:
                score[i] = max(score.get(i, -np.inf), float((np.array(v) * x[q]).sum()))
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert [i for i, _ in found] == want and all(abs(s - score[i]) < 1e-9 for i, s in found)


def test_vectors_of_any_finite_length_take_part(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(120, 3))
    x[100] = [1e200, 1, 1]
    x[101] = [-1.5e308, 1.5e308, 1e308]
    x[102] = [1e-310, 2e-310, 0]
    x[103] = [300.0, 5, 5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in ann.search(df, F.col("vec_id") % 20 == 0, list_rows=10).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append(row["vec_id"])
    assert sorted(got) == [0, 20, 40, 60, 80, 100]
    hits = 0
    for q, found in got.items():
        with np.errstate(all="ignore"):
            scores = np.nan_to_num((x * x[q]).sum(axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        want = sorted((i for i in range(120) if i != q), key=lambda i: (-scores[i], i))[:20]
        assert len(found) == 20 and found[:1] == want[:1]
        hits += len(set(found) & set(want))
    assert hits >= 0.9 * 120


def test_ann_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0], 1), (None, [1.0, 1.0], 1), (8, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int")
    got = [(r[0], r[1], r[2], r[3]) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect()]
    assert got == [(0, 1, 1, 1.0)]
    assert ann.search(df.filter("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_temporal_list(spark):
    at = lambda d: f"2024-01-{d:02d} 00:00:00"
    entries = [("host", "Bad.com", "add", at(5)), ("host", "bad.com", "add", at(6)), ("host", "bad.com", "remove", at(10)), ("host", "bad.com", "add", at(20)), ("domain", "evil.org", "add", at(1)), ("url", "ok.com/a/b/", "add", at(1)), ("host", "tie.com", "add", at(3)), ("host", "tie.com", "remove", at(3)), (None, "x.com", "add", at(1)), ("host", None, "add", at(1)), ("host", "n.com", "add", None)]
    e = spark.createDataFrame(entries, "kind string, pattern string, action string, listed_at string").withColumn("listed_at", F.col("listed_at").cast("timestamp_ntz"))
    cases = [(1, "http://bad.com/x", at(4), False), (2, "http://BAD.com/x", at(5), True), (3, "http://bad.com", at(9), True), (4, "http://bad.com/", at(10), False), (5, "https://u:p@bad.com:8080/x?y", at(25), True), (6, "http://a.b.evil.org/", at(2), True), (7, "http://notevil.org/", at(2), False), (8, "http://ok.com/a/b/c?d", at(2), True), (9, "http://ok.com/a/bc", at(2), False), (10, "http://tie.com/", at(9), False), (11, None, at(9), False), (12, "nonsense", at(9), False), (13, "http://bad.com/", None, False), (None, "http://bad.com/", at(6), True), (2, "http://BAD.com/x", at(5), True)]
    c = spark.createDataFrame(cases, "page_id long, url string, at string, want boolean").withColumn("fetched_at", F.col("at").cast("timestamp_ntz"))
    got = urlfilter.evaluate(c, e).collect()
    assert len(got) == len(cases) and all(r["blocked"] == r["want"] for r in got)
    assert urlfilter.evaluate(c.filter("false"), e).count() == 0
    assert urlfilter.evaluate(c, e.filter("false")).filter("blocked").count() == 0


def test_entries_and_captures_are_read_alike(spark):
    at = "2024-01-01 00:00:00"
    entries = [("url", "a.com/"), ("url", "http://b.com//x/"), ("url", "C.com.:80/y?q#f"), ("host", "https://D.com./"), ("domain", "*.e.org"), ("domain", ".f.org."), ("url", "g.com/A"), ("url", ""), ("host", ".."), ("url", "[::1]/x"), ("what", "z.com")]
    e = spark.createDataFrame([(k, p, "add", at) for k, p in entries], "kind string, pattern string, action string, listed_at string").withColumn("listed_at", F.col("listed_at").cast("timestamp_ntz"))
    cases = {
        "http://a.com/": True, "http://a.com": True, "http://a.com/x/y": True, "http://a.com?x": True, "http://b.a.com/": False, "http://b.com/x//z": True, "http://b.com//x": True, "http://b.com/xx": False,
        "http://c.com/y/1": True, "http://c.com./y": True, "http://c.com/z": False, "http://d.com.:9/": True, "http://x.d.com/": False, "http://e.org/": True, "http://a.b.e.org./p": True, "http://ee.org/": False,
        "ftp://u:p@f.org": True, "http://g.com/A/b": True, "http://g.com/a": False, "http://[::1]:80/x/y": True, "http://[::2]/x": False, "a.com/x": False, "http:///x": False, "http://": False, "http://z.com": False,
    }
    rows = [(i, u, at, 1, 2, 3, 4) for i, u in enumerate(cases)] + [(99, None, at, 1, 2, 3, 4), (100, "http://a.com/", None, 1, 2, 3, 4)]
    c = spark.createDataFrame(rows, "page_id long, url string, at string, _id int, _url int, entry int, blocked int").withColumn("fetched_at", F.col("at").cast("timestamp_ntz")).drop("at")
    done = urlfilter.evaluate(c, e)
    assert done.columns == ["page_id", "url", "_id", "_url", "fetched_at", "blocked", "n_entries", "entry"]
    got = {r["url"] if r["fetched_at"] else "no time": r["blocked"] for r in done.collect()}
    assert got == cases | {None: False, "no time": False}


def test_a_url_of_many_segments_takes_time_in_proportion(spark):
    at = "2024-01-01 00:00:00"
    long = "http://a.com/" + "/".join(f"s{i}" for i in range(50_000))
    e = spark.createDataFrame([("url", "a.com/s0/s1", "add", at), ("url", long, "add", at), ("domain", "b.com", "add", at)], "kind string, pattern string, action string, listed_at string").withColumn("listed_at", F.col("listed_at").cast("timestamp_ntz"))
    c = spark.createDataFrame([(1, long, at), (2, "http://" + "x." * 50_000 + "b.com/", at)], "page_id long, url string, at string").withColumn("fetched_at", F.col("at").cast("timestamp_ntz")).drop("at")
    urlfilter.evaluate(c.limit(0), e).collect()
    began = time.perf_counter()
    assert {r["page_id"]: r["n_entries"] for r in urlfilter.evaluate(c, e).collect()} == {1: 2, 2: 1}
    assert time.perf_counter() - began < 20
