"""Reversed search against a plain count of every term of every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reelmill.llm import ranked_search as rs

DOC, ITEM = "doc_id long, text string", "item_id int, text string"


def terms_of(text):
    small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small)


def by_force(docs, items, k):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c
            )
            if score > 0:
                scored.append((-score, i is not None, i, score))
        out += [(item, r, x[2], x[3]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def rows(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize(("k", "block"), [(10, 1 << 20), (3, 20)])
def test_search_by_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(rs, "CELLS", 64)
    rng = random.Random(k)
    words = [f"w{i}" for i in range(30)] + ["Été", "été", "日本", "a_b", "ÀB", "x" * 300, " ", "9"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "\n", "\x00"]) for _ in range(rng.randrange(n)))
    docs = [(i, text(40)) for i in range(120)]
    docs += [(500 + i, docs[3][1]) for i in range(40)] + [docs[5], docs[5], (7, "w1 w2"), (None, docs[3][1]), (None, None), (800, ""), (801, "w1 " * 5000)]
    items = [(i, text(12)) for i in range(15)] + [(3, "w29 w28"), (None, "w1 w2"), (99, None), (98, ""), (97, "nothing_of_that")]
    found = rs.rank_documents(spark.createDataFrame(docs, DOC).repartition(5), spark.createDataFrame(items, ITEM), k=k, block_pairs=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(found) == by_force(docs, items, k)


def test_search_of_nothing_and_of_other_ids(spark):
    docs, items = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    some = spark.createDataFrame([(1, "a b")], DOC)
    assert rs.rank_documents(docs, items).count() == rs.rank_documents(some, items).count() == 0
    assert rs.rank_documents(docs, some.withColumnRenamed("doc_id", "item_id")).count() == 0
    named = spark.createDataFrame([("b", "x y", 1), ("a", "x y", 2), ("c", "y", 3), (None, "x y", 4)], "doc_id string, text string, score int")
    got = rs.rank_documents(named, spark.createDataFrame([("q", "x", "z")], "item_id string, text string, rank string"), k=2)
    assert [(r.item_id, r.doc_id) for r in got.orderBy("rank").collect()] == [("q", None), ("q", "a")]


def test_heaps_keep_the_first_of_equals():
    heaps = rs.Heaps(1, 2)
    for ids in ([9, 4, 7], [3, 8, None]):
        heaps.offer(np.array([[5], [5], [5]]), pa.array(ids, pa.int64()))
    assert sorted(heaps.rows()[2], key=str) == [3, None]


def test_norms_and_scores_beyond_64_bits():
    n = np.array([10**6, 3])
    assert rs.length_norms(n, 10**13, 10**15).tolist() == [10 + 90 * x * 10**13 // 10**15 for x in (10**6, 3)]
    index = rs.Index(["i"], [(0, t) for t in range(4)])
    args = (np.zeros(4, np.int64), np.arange(4), np.full(4, 10**6), np.array([10]))
    plain, wide = (rs.scores(index, np.array(w, np.int64), *args)[0, 0] for w in ([3, 1, 2, 1], [10**12, 1, 1, 1]))
    gain = 10**15 // (10**9 + 80)
    assert plain == 7 * gain and wide == (10**12 + 3) * gain
