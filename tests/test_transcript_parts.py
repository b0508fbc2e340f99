"""Documents are dealt by id once, into parts of bounded size, and their windows shuffle nothing else."""

import pytest
from conftest import SF_DIR

import __spark_entry__ as project
from reelmill.plans import library

QUERIES = project.queries()


def test_more_text_makes_more_parts(spark, monkeypatch):
    before = {tuple(r) for r in library.transcript(spark, SF_DIR).collect()}
    monkeypatch.setattr(library, "TEXT_CHARS", 10_000, raising=False)
    size = sum(r.n_chars + 1 for r in library.table(spark, SF_DIR, "documents").collect())
    made = library.transcript(spark, SF_DIR)
    assert made.rdd.getNumPartitions() == -(-size // 10_000) > spark.sparkContext.defaultParallelism
    assert {tuple(r) for r in made.collect()} == before


@pytest.mark.parametrize("name", ["window_embedding", "transcript_windows"])
def test_windows_are_made_where_the_documents_are(spark, monkeypatch, name):
    monkeypatch.setattr(library, "TEXT_CHARS", 10_000, raising=False)
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and all("doc_id" in line and "REPARTITION_BY_NUM" in line for line in dealt)
    parts = {line.split("hashpartitioning(")[1].split(")")[0].split(", ")[-1] for line in dealt}
    assert len(parts) == 1 and int(parts.pop()) > spark.sparkContext.defaultParallelism


def test_documents_without_size_or_text(spark, tmp):
    rows = [(1, "a\nbc", None), (2, "", 0), (3, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp}/documents.parquet")
    got = sorted((r.video_no, r.line_no, r.start_sec, r.end_sec, r.text) for r in library.transcript(spark, tmp).collect())
    assert got == [(1, 0, 0.0, 0.0625, "a"), (1, 1, 0.0625, 0.1875, "bc"), (2, 0, 0.0, 0.0, "")]
    assert project.queries()["window_embedding"](spark, tmp).count() > 0
