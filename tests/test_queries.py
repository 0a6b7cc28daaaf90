import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(str(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.sql(oracle.ORACLE_SQL[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) == set(oracle.ORACLE_SQL)
    assert entry.entry(spark).count() == 20


def test_seek_finds_the_last_entry_before(spark, sf_dir):
    placed = {(r["topic"], r["part"], r["off"]): r for r in queries.QUERIES["segment_assignment"](spark, sf_dir).collect()}
    for r in queries.QUERIES["index_seek"](spark, sf_dir).collect():
        own = [x for x in placed.values() if (x["topic"], x["part"], x["segment_base"]) == (r["topic"], r["part"], r["segment_base"]) and x["indexed"] and x["off"] <= r["off"]]
        assert r["start_pos"] == max((x["file_pos"] for x in own), default=68)
