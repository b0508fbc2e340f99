"""Alignment of two tokenizers against one text at a time, with the libraries' own tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelmill.llm import token_alignment as ta
from reelmill.llm.bpe import byte_signs
from reelmill.llm.queries import vocabulary_path

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"
FILES = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def tokens_by_force(text, libraries):
    a, b = libraries
    signs = byte_signs()
    if not text:
        return [], []
    ids = a.encode(" " + text, add_special_tokens=False).ids
    left = [(i, bytes(signs[c] for c in a.id_to_token(i))) for i in ids]
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    raw = (" " + text).encode()
    if any(b"".join(x for _, x in side) != raw for side in (left, right)):
        return [], []
    return left, right


def spans(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def by_force(rows, libraries):
    aligned, corpus = [], Counter()
    for doc, text in rows:
        left, right = map(spans, tokens_by_force(text, libraries))
        cuts = sorted({e for _, _, e in left} & {e for _, _, e in right})
        groups, low = [], 0
        for cut in cuts:
            groups.append([",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in (left, right)])
            low = cut
        links, j = [], 0
        for i, s, e in left:
            while right[j][2] <= s:
                j += 1
            k = j
            while k < len(right) and right[k][1] < e:
                links.append((i, right[k][0]))
                k += 1
        corpus.update(links)
        aligned.append((doc, len(left), len(right), len(cuts), links, ";".join("|".join(g) for g in groups)))
    best = defaultdict(int)
    for (_, b), n in corpus.items():
        best[b] = max(best[b], n)
    return Counter(
        (doc, na, nb, cuts, len(links), sum(corpus[x] == best[x[1]] for x in links), sum(corpus[x] for x in links), groups and hashlib.sha256(groups.encode()).hexdigest())
        for doc, na, nb, cuts, links, groups in aligned
    )


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


ODD = [None, "", " ", "  two  spaces ", "▁", "<0x41> <s> </s> <|endoftext|> [UNK]", "é" * 30, "日本語のテキスト", "a\x00b", "\n\n\tx\r\n", "👩‍👩‍👧 ½ ﬁ", "x" * 3000, "12345 67,890.12"]


@pytest.mark.parametrize("known", [0, 40, 1 << 19])
def test_alignment_by_brute_force(spark, libraries, monkeypatch, known):
    monkeypatch.setattr(ta, "SLICE_BYTES", 500)
    monkeypatch.setattr(ta, "COUNTED", 50)
    monkeypatch.setattr(ta, "DIGESTED", 7)
    rng = random.Random(1)
    pool = ["the quick", " brownish", "foxes", "\n", "unbelievably", "Straße", "naïve", ".", "e.g.", "0x1F", "ñandú", "日本", "  ", "<s>"]
    rows = [(i, "".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randrange(40)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [rows[3], rows[3], (3, "another"), (None, rows[4][1])]
    df = spark.createDataFrame(rows, DOC).withColumn("row", F.lit("clash")).withColumn("pair", F.lit(1)).repartition(3)
    assert rows_of(ta.align_tokenizers(df, *FILES, known_pairs=known)) == by_force(rows, libraries)


def test_alignment_of_the_tables(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(ta.align_tokenizers(docs, *FILES)) == by_force(rows, libraries)


def test_groups_hold_the_same_bytes(spark, libraries):
    signs = byte_signs()
    rows = [(i, t) for i, t in enumerate([*ODD, "Some plain words, unevenly cut."])]
    for r in ta.token_groups(spark.createDataFrame(rows, DOC), *FILES).collect():
        left, right = tokens_by_force(rows[r.doc_id][1], libraries)
        assert (r.a, r.b) == ([i for i, _ in left], [i for i, _ in right])
        assert len(r.a_ends) == len(r.b_ends)
        assert (r.a_ends[-1:], r.b_ends[-1:]) == ([len(left)][: len(left)], [len(right)][: len(right)])
        for x, y in zip(r.a_ends, r.b_ends):
            assert b"".join(t for _, t in left[:x]) == b"".join(t for _, t in right[:y])
    assert signs


def test_alignment_of_nothing(spark):
    assert ta.align_tokenizers(spark.createDataFrame([], DOC), *FILES).count() == 0
    bare = ta.align_tokenizers(spark.createDataFrame([("x", None), ("y", "")], "doc_id string, text string"), *FILES)
    assert sorted(map(tuple, bare.collect())) == [("x", 0, 0, 0, 0, 0, 0, ""), ("y", 0, 0, 0, 0, 0, 0, "")]


def test_counts_are_merged(monkeypatch):
    monkeypatch.setattr(ta, "COUNTED", 3)
    counts = ta.Counts()
    for part in ([5, 5, 1], [1, 9], [5]):
        counts.add(np.array(part))
    assert [x.tolist() for x in counts.taken()] == [[1, 5, 9], [2, 3, 1]]
    assert [x.tolist() for x in counts.taken()] == [[], []]
