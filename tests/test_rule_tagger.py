"""The rule tagger against its SQL on words with hyphens and apostrophes, and on screen text of several lines."""

import datetime
from pathlib import Path

import duckdb

import __spark_entry__ as project

QUERIES, CHECKS = project.queries(), project.oracle_sql()


def test_titles_and_first_lines_equal_sql(spark, tmp):
    start = datetime.datetime(2024, 1, 1)
    # video 1 is voiced, video 2 silent
    texts = [(1, "Licensed under CC by-nc don't", 29), (2, "unused", 6)]
    events = [(i, user, start, "view", props) for i, (user, props) in enumerate([(1, '{"k": 1}'), (2, '\n {"k": 1,\n "later": 2}')])]
    con = duckdb.connect()
    for name, rows, kind in (
        ("documents", texts, "doc_id long, text string, n_chars long"),
        ("events", events, "event_id long, user_id long, ts timestamp_ntz, event_type string, props string"),
    ):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp}/{name}.parquet")
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM '{Path(tmp)}/{name}.parquet/*.parquet'")
    df = QUERIES["rule_tagger"](spark, tmp)
    got = sorted(tuple(r) for r in df.select("video_no", "topic", "tags").collect())
    assert got == [(1, "Licensed Under Cc By-Nc", "licensed|under|cc|by-nc|don't"), (2, "Sample Lesson", "")]
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({CHECKS['rule_tagger']}) ORDER BY video_no").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == want
