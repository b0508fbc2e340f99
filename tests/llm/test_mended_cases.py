"""Rows of one id with different texts, benchmark items shorter than a q-gram, fingerprints of texts without windows, and fingerprints by definition."""

import itertools
import math
import random
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reelmill.llm import bpe, decontaminate, fingerprint, minhash
from reelmill.llm.words import ODD, mix

DOC = "doc_id long, text string"


def test_one_of_each_keeps_every_text_of_an_id(spark):
    texts = [" ".join(f"{w}{i}" for i in range(30)) for w in "abcd"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1].upper()), (2, texts[2]), (3, texts[1]), (4, ""), (4, None), (4, " \n"), (None, texts[3]), (None, texts[3])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], DOC + ", version0 string")
    got = minhash.one_of_each(df)
    assert got.columns == df.columns
    kept = Counter((r.doc_id, (r.text or "").lower()) for r in got.collect())
    assert kept == Counter([(1, texts[0]), (1, texts[1]), (2, texts[2]), (4, ""), (4, " \n"), (None, texts[3]), (None, texts[3])])


def test_short_items_match_as_whole_words(spark):
    rng = random.Random(0)
    pool = ["yes", "no", "a", "of", "yes no", "é", "maybe", "42", "oui!"]
    docs = [(i, rng.choice(["", " "]) + rng.choice([" ", ", ", "-", ""]).join(rng.choice([*pool, "yesno", "YES", "noé"]) for _ in range(rng.randrange(6)))) for i in range(150)]
    docs += [(200, None), (201, "a long passage of some words that is an item of its own, yes")]
    items = [*enumerate([*pool, "...", "", "a long passage of some words that is an item"]), (50, "yes"), (51, None)]
    got = decontaminate.leaked_passages(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id): r for r in got.collect()}

    def normal(text):
        return re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", (text or "").lower()).strip()

    want = {(d, i) for (d, t), (i, x) in itertools.product(docs, items) if normal(x) and f" {normal(x)} " in f" {normal(t)} "}
    assert set(found) == want and (201, 11) in want
    text_of, item_of = dict(docs), dict(items)
    for (d, i), r in found.items():
        assert r.edits == 0 and normal(text_of[d][r.start_char : r.end_char]) == normal(item_of[i])
    clean = decontaminate.clean_documents(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def alike(a, b):
    x, y = fingerprint.fingerprints(pa.array([a, b]))
    assert fingerprint.likeness(x, y) == fingerprint.likeness(y, x)
    return fingerprint.likeness(x, y)


@pytest.mark.parametrize(
    ("a", "b", "least", "most"),
    [
        ("a" * 5000, "a" * 5001, 1, 1),
        ("hello world abc", "hello world abd", 0.7, 0.99),
        ("hello world abc", "hello world abc and more", 0.9, 1),
        ("a" * 5000, "a" * 4990 + " with an end", 0.9, 1),
        ("abc", "abc", 1, 1),
        ("ab", "abc", 0, 0.3),
        ("\x00", "\x00\x00", 0, 0.3),
        ("hello world abc", "quite other txt", 0, 0.2),
        ("", "x", 0, 0),
        ("", "", 1, 1),
    ],
)
def test_likeness_of_texts_without_windows(a, b, least, most):
    assert least - 1e-9 <= alike(a, b) <= most + 1e-9


def test_likeness_is_symmetric():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(300)]
    for n in (30, 200, 900):
        text = [rng.choice(words) for _ in range(n)]
        other = [w if rng.random() < 0.95 else rng.choice(words) for w in text]
        assert 0 < alike(" ".join(text), " ".join(other)) < 1


def plain_features(data, windows):
    """The features of one text by definition: their window hashes in order."""
    width, run, votes, usual = windows
    places = len(data) - width + 1
    ranks = []
    for i in range(places):
        counts = Counter(data[i : i + width])
        h = math.log2(width) - sum(c * math.log2(c) for c in counts.values()) / width
        ranks.append(1000 if h < fingerprint.LEAST else min(max(900 - round(abs(h - usual) * 200), 0), 999))
    won = Counter()
    for low in range(-run + 1, places) if places > 0 else ():
        rank, i = min((ranks[i], i) for i in range(max(low, 0), min(low + run, places)))
        won[i] += rank < 1000
    out = []
    for i in sorted(i for i, n in won.items() if n >= votes):
        x = np.zeros(1, np.uint64)
        for k in range(0, width, 8):
            x = mix(x * ODD[0] ^ np.frombuffer(data[i + k : i + k + 8], "<u8"))
        if int(x[0]) not in out:
            out.append(int(x[0]))
    return out


def test_fingerprints_by_definition():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmno é,.") for _ in range(6)) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 3, 5, 40, 120)] + ["a" * 300, "xyz" * 100]
    for text, digest in zip(texts, fingerprint.fingerprints(pa.array(texts))):
        data, want = text.encode(), []
        short = plain_features(data, fingerprint.OF_SHORT)
        runs = list(dict.fromkeys(data[i : i + 4] for i in range(len(data) - 3)))
        kinds = [(16, short)] + [(64, plain_features(data, fingerprint.OF_LONG))] * (len(text) >= fingerprint.LONG)
        for width, found in kinds:
            for low in range(0, len(found), fingerprint.FEATURES_IN_FILTER):
                bits = {(x >> 11 * k) & 2047 for x in found[low : low + fingerprint.FEATURES_IN_FILTER] for k in range(fingerprint.BITS_OF_FEATURE)}
                want.append((width, bits))
        got = [(row[0], {8 * i + k for i in range(256) for k in range(8) if row[1 + i] >> k & 1}) for row in digest.tolist()]
        assert [g for g in got if g[0] != 4] == want
        assert (4 in [g[0] for g in got]) == (not short or len(runs) <= fingerprint.FEATURES_IN_FILTER)
        for _, bits in [g for g in got if g[0] == 4]:
            assert len(bits) <= 5 * fingerprint.FEATURES_IN_FILTER


def test_ids_that_are_no_numbers_are_refused_by_name(spark):
    with pytest.raises(TypeError, match="doc_id"):
        fingerprint.compare_with_edit(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_remembered_words_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 40_000)
    calls = []
    memory = bpe.Remembered(lambda k: calls.append(k) or k.encode())
    for i in range(3000):
        assert memory[f"word {i}"] == f"word {i}".encode()
        assert sum(bpe.ENTRY_BYTES + sys.getsizeof(k) + sys.getsizeof(v) for k, v in memory.items()) <= 40_000
    assert 0 < len(memory) < 300 and memory["word 2999"] and len(calls) == 3000
    assert memory["x" * 50_000] and "x" * 50_000 not in memory
