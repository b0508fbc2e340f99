"""Every query with SQL equals DuckDB on the same tables; the others return rows."""

import math
from collections import Counter

import duckdb
import pytest
from conftest import SF_DIR

import __spark_entry__ as project

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, CHECKS = project.queries(), project.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(CHECKS[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert got == want
    assert got, "the check compares nothing"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_list_search_finds_nine_in_ten(spark):
    rows = QUERIES["ann_topk_batch"](spark, SF_DIR).collect()
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    assert {r.query_no for r in rows} == {r.vec_id for r in vectors.where("vec_id % 50 = 0").collect()}
    assert min(Counter(r.query_no for r in rows).values()) == 10 and rows[0].recall >= 0.9


def test_upsert_reaches_every_video(spark):
    stored = QUERIES["stable_video_id"](spark, SF_DIR)
    after = QUERIES["upsert_latest_whole"](spark, SF_DIR)
    assert stored.join(after, "video_id", "left_anti").count() == 0
    assert after.count() == after.select("video_id").distinct().count() > stored.count()


def test_entry(spark):
    assert project.entry(spark).limit(1).count() == 1
