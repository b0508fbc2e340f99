"""N-gram Jaccard join against a comparison of all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmill.llm import ngram_join as nj

DOC = "doc_id long, text string"


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) < words:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def by_force(rows, words, percent):
    """Rows with one id are one document; rows without an id stand for their text."""
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(i)] = root(j)
    members = {}
    for i, (doc, _) in enumerate(rows):
        members.setdefault(root(i), []).append(doc)
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in members.items()}
    return Counter((doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows))


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[f"new{rng.randrange(999)}"], [], [words[k], "more"]])
    return " ".join(words)


def corpus(seed, near=40):
    rng = random.Random(seed)
    common = " ".join(f"boiler{i}" for i in range(30))
    fresh = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(n))
    texts = [fresh(rng.randrange(1, 120)) for _ in range(60)]
    texts += [common + " " + fresh(rng.choice([2, 5, 40])) for _ in range(40)]
    base = fresh(150)
    texts += [edited(rng, base, rng.randrange(0, 4)) for _ in range(near)]
    for n in (1, 2, 3, 4, 9, 10, 11, 12, 13, 21, 22):
        t = fresh(n)
        texts += [t, t.upper(), t + " x", edited(rng, t, 1), "  " + t.replace(" ", "\n")]
    texts += [edited(rng, rng.choice(texts), rng.randrange(3)) for _ in range(60)]
    texts += ["", " \n ", texts[100], texts[100], texts[0]]
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)] + [(5000, None), (None, texts[7]), (None, "only here without id")]


@pytest.mark.parametrize(("words", "percent", "small", "block"), [(3, 90, 24, 16 << 20), (3, 90, 1, 6000), (5, 80, 3, 20000), (2, 60, 2, 9000)])
def test_components_by_brute_force(spark, monkeypatch, words, percent, small, block):
    monkeypatch.setattr(nj, "SMALL_GROUP", small)
    monkeypatch.setattr(nj, "BLOCK_BYTES", block)
    monkeypatch.setattr(nj, "FEW", 5)
    rows = corpus(words * percent + small)
    df = spark.createDataFrame(rows, DOC).withColumn("no", F.lit("clash")).withColumn("n", F.lit(0)).repartition(3)
    got = nj.ngram_components(df, words=words, percent=percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == by_force(rows, words, percent)


def test_join_of_nothing_of_other_ids_and_of_versions(spark):
    assert nj.ngram_components(spark.createDataFrame([], DOC)).count() == 0
    rows = [("b", "one two three four five six"), ("a", "ONE two three four five six"), ("c", ""), ("c", None)]
    got = nj.ngram_components(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sorted(map(tuple, got.collect())) == [("a", 2, "a"), ("b", 2, "a"), ("c", 0, "c"), ("c", 0, "c")]
    texts = ["a b c d e f g", "h i j k l m n"]
    got = nj.ngram_components(spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[1]), (2, texts[1])], DOC))
    assert sorted(map(tuple, got.collect())) == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (2, 3, 1)]


@pytest.mark.parametrize("percent", [51, 80, 85, 90, 99])
def test_filters_pass_every_linked_pair(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[: len(x) - int(rng.integers(0, 1 + len(x) * (100 - percent) // 100 + 1))], rng.integers(0, 1 << 60, int(rng.integers(0, 8))).astype(np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if not len(y) or 100 * shared < percent * (len(x) + len(y) - shared):
            continue
        assert shared >= nj.pair_overlap(len(x), len(y), percent)
        first = [s[: nj.first_length(len(s), percent)] for s in (x, y)]
        assert len(np.intersect1d(*first)) >= nj.certain(nj.least_overlap(max(len(x), len(y)), percent), percent) >= 1
        for seed in (1, 2):
            p = [nj.order_of(s, np.array([0, len(s)]), seed)[: nj.prefix_length(len(s), percent)] for s in (x, y)]
            assert nj.may_be_linked(*p, len(x), len(y), percent)


def test_far_pairs_are_filtered():
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 1 << 60, 400).astype(np.uint64))
    y = np.unique(np.concatenate([rng.permutation(x)[:100], rng.integers(0, 1 << 60, 300).astype(np.uint64)]))
    p = [nj.order_of(s, np.array([0, len(s)]), 1)[: nj.prefix_length(len(s), 90)] for s in (x, y)]
    assert np.isin(*p).any() and not nj.may_be_linked(*p, len(x), len(y), 90)
