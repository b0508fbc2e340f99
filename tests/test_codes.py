"""Vector codes: recall against exact search, what is looked up, and the codebook by hand."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from conftest import SF_DIR

import __spark_entry__ as project
from reelmill.operators import codes, search

SEGMENT = "video_no long, seg_index int, status string, embedding array<float>"


@pytest.fixture(scope="module")
def segments(spark):
    rng = random.Random(2)
    rows = [(v, 0, "soft_deleted" if v % 10 == 1 else "done", [rng.gauss(0, 1) for _ in range(21)]) for v in range(3000)]
    rows += [(5000, 0, "done", None), (5001, 0, "done", [0.0] * 21), (5002, 0, "done", [2 * x for x in rows[0][3]])]
    return spark.createDataFrame(rows, SEGMENT)


def test_codes_find_nine_in_ten_and_look_up_less_than_a_tenth(spark, tmp, segments):
    path = codes.build_codes(segments, f"{tmp}/codes", k=10, parts=8)
    stored, book, candidates = codes.open_codes(spark, path)
    assert {len(r.code) for r in stored.collect()} == {8} and stored.count() == 3001
    assert 10 <= candidates < 300
    rng = random.Random(9)
    queries = spark.createDataFrame([(q, [rng.gauss(0, 1) for _ in range(21)]) for q in range(40)], "query_no long, vector array<double>")
    found = codes.code_topk(stored, book, segments, queries, 10, candidates)
    exact = search.semantic_topk_batch(segments, queries, 10)
    assert search.recall_of_batch(found, exact).first().recall >= 0.9
    assert Counter(r.query_no for r in found.collect()) == {q: 10 for q in range(40)}
    scores = {(r.query_no, r.video_no): r.score for r in exact.collect()}
    assert all(abs(scores.get((r.query_no, r.video_no), r.score) - r.score) < 2e-6 for r in found.collect())


def test_all_rows_as_candidates_give_the_exact_answer(spark, tmp, segments):
    book = codes.fit_codebook(segments, parts=5, sample_rows=200)
    queries = spark.createDataFrame([(1, [1.0] * 21), (2, [0.0] * 20 + [1.0])], "query_no long, vector array<double>")
    found = codes.code_topk(codes.encode_rows(segments, book), book, segments, queries, 7, 4000)
    exact = search.semantic_topk_batch(segments, queries, 7)
    rows = lambda df: sorted((r.query_no, r.place, r.video_no) for r in df.collect())
    assert rows(found) == rows(exact)


def test_codebook_of_few_distinct_values_loses_nothing():
    x = codes._unit(np.array([[1.0, 2, 3, 4, 5], [5, 4, 3, 2, 1], [1, 2, 3, 4, 5]]))
    book = codes.Codebook([codes._centres(p, 256, np.random.default_rng(0)) for p in np.array_split(x, 2, axis=1)])
    assert np.allclose(book.decode(book.encode(x)), x)
    many = np.random.default_rng(1).normal(size=(2000, 4))
    c = codes._centres(many, 16, np.random.default_rng(0))
    assert c.shape == (16, 4) and ((many - c[codes._nearest(many, c)]) ** 2).sum(1).mean() < 0.5 * (many**2).sum(1).mean()


def test_codes_of_nothing(spark, tmp):
    none = spark.createDataFrame([], SEGMENT)
    stored, book, candidates = codes.open_codes(spark, codes.build_codes(none, f"{tmp}/codes"))
    queries = spark.createDataFrame([(1, [1.0])], "query_no long, vector array<double>")
    assert codes.code_topk(stored, book, none, queries, 3, candidates).count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_search_at_every_size(spark, size):
    folder = SF_DIR.replace("sf0.001", size)
    rows = project.queries()["ann_codes_batch"](spark, folder).collect()
    asked = spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id % 50 = 0")
    assert {r.query_no for r in rows} == {r.vec_id for r in asked.collect()}
    assert rows[0].recall >= 0.9 and rows[0].looked_up < 0.1
    print(size, rows[0].recall, rows[0].looked_up)


def test_tiles_and_groups_of_queries_hold_little_and_give_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(300, 8)), 1)
    block = [{"query_no": i, "vector": list(v)} for i, v in enumerate(vectors[:40])]
    batches = [pd.DataFrame({"video_no": range(i, i + 60), "seg_index": 0, "embedding": list(vectors[i : i + 60]), "list_no": np.arange(60) % 3}) for i in range(0, 300, 60)]
    shapes, real = [], np.partition

    def seen(a, *args, **more):
        shapes.append(a.size)
        return real(a, *args, **more)

    monkeypatch.setattr(np, "partition", seen)

    def best(near, k=20):
        out = pd.concat(search._best_of_partition(block, k, near)(iter(batches)))
        out = out.sort_values(["query_no", "score", "video_no"], ascending=[True, False, True]).groupby("query_no").head(k)
        return out.reset_index(drop=True)

    for near in (None, lambda m: (np.arange(3)[None, :] != (np.arange(len(m)) % 3)[:, None])):
        with monkeypatch.context() as m:
            whole = best(near)
            m.setattr(search, "TILE_SCORES", 200)
            m.setattr(search, "KEPT_ROWS", 100)
            m.setattr(search, "HELD_ROWS", 120)
            shapes.clear()
            small = best(near)
            assert not shapes or max(shapes) <= 200
        pd.testing.assert_frame_equal(whole, small)
        assert len(whole) == 40 * 20
    assert search.TILE_SCORES * 8 <= 1 << 24
