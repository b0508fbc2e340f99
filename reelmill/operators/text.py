"""Keywords, keyphrases and entity lists of texts."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.columns import norm, round_even, search_tokens
from reelmill.functions.phrases import Phrases, Words, best_rows, from_planes, joined_texts, planes, sum_by_key, text_slices
from reelmill.functions.vectors import DIGEST_DIM, digest_embedder
from reelmill.schemas import PHRASE_MAX_CHARS, PHRASE_MIN_CHARS, STOP_WORDS, TOP_ENTITIES, TOP_KEYWORDS

# Counted phrases that leave a task at once; a batch of texts holds hundreds of times as many phrases as texts.
PHRASE_ROWS = 1 << 16
# Bytes of texts whose phrases ask for their document frequencies together.
BLOCK_BYTES = 8 << 20
_ASKED = ["part", "block", "steps", "narrow", "own"]
_STOPPED = pa.array(STOP_WORDS)


def _counts(tokens: list[str]) -> dict[str, int]:
    """Occurrences of tokens and neighbouring pairs of 2 to 40 characters in one text."""
    seen = Counter(tokens)
    seen.update(map(" ".join, pairwise(tokens)))
    return {p: n for p, n in seen.items() if PHRASE_MIN_CHARS <= len(p) <= PHRASE_MAX_CHARS}


def _phrase_rows(key: str, top: int | None = None):
    """Batches of (key, ``tokens``) to batches of counted phrases of about ``PHRASE_ROWS`` rows, whatever the texts of a batch hold."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids: list = []
            found: list[tuple[str, int, int, int]] = []

            def rows(ids: list, found: list, kind=pdf[key].dtype) -> pd.DataFrame:
                out = pd.DataFrame(found, columns=["phrase", "n", "total", "place"])
                out.insert(0, key, pd.Series(ids, dtype=kind))
                return out

            for doc, words in zip(pdf[key], pdf["tokens"], strict=True):
                seen = _counts(words.split(" ") if words else [])
                total = sum(seen.values())
                items = seen.items()
                if top is None:
                    ranked = [(p, n, total, 0) for p, n in items]
                else:
                    best = heapq.nsmallest(top, items, key=lambda x: (-x[1], x[0].encode()))
                    ranked = [(p, n, total, i) for i, (p, n) in enumerate(best, start=1)]
                ids.extend([doc] * len(ranked))
                found.extend(ranked)
                if len(found) >= PHRASE_ROWS:
                    yield rows(ids, found)
                    ids, found = [], []
            yield rows(ids, found)

    return count


def phrase_counts(docs: DataFrame, key: str, tokens: Column, top: int | None = None) -> DataFrame:
    """Count per (text, phrase) with the text's ``total``; only the ``top`` most frequent ones if given.

    All phrases of a text come from its one row, so they are counted where the row is and nothing is shuffled.
    """

    kind = docs.schema[key].dataType.simpleString()
    # one string per text crosses to Python, not one per token
    listed = docs.select(key, F.array_join(tokens, " ").alias("tokens"))
    return listed.mapInPandas(_phrase_rows(key, top), f"{key} {kind}, phrase string, n long, total long, place int")


def keyword_share(docs: DataFrame, key: str = "doc_id", top: int = TOP_KEYWORDS) -> DataFrame:
    """Most frequent phrases of each text with their share; ties by phrase."""
    counts = phrase_counts(docs, key, search_tokens(F.col("text")), top)
    return counts.select(key, "phrase", round_even(F.col("n") / F.col("total"), 3).alias("score"), "place")


def _joined_tokens(text: Column) -> Column:
    """:func:`search_tokens` with a blank between them, without a string for each."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _without_stop_words(texts: pa.Table | pa.RecordBatch) -> Phrases:
    words = Words(joined_texts(texts.column("tokens")))
    return Phrases(words.keep(~np.asarray(pc.is_in(words.vocabulary, _STOPPED), bool)[words.word]))


def _ask(parts: int) -> Callable[[pa.Table], pa.Table]:
    """What a block of texts asks for: its distinct phrases by hash, in ranges of the hash, with the number of its texts that have each."""

    def ask(block: pa.Table) -> pa.Table:
        found = _without_stop_words(block)
        wide, narrow = found.hashed()
        order = np.argsort(wide, kind="stable")
        wide, narrow = wide[order], narrow[order]
        own = np.bincount(found.phrase, minlength=len(wide))[order].astype(np.uint32)
        step = np.diff(wide, prepend=np.uint64(0))
        part = ((wide >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        step[starts] = wide[starts]
        rows = list(zip(starts.tolist(), np.append(starts[1:], len(part))[: len(starts)].tolist(), strict=True))
        columns = [pa.array([planes(x[i:j]) for i, j in rows], pa.binary()) for x in (step, narrow, own)]
        return pa.table([pa.array(part[starts]), block.column("block")[:1].take(pa.array([0] * len(rows), pa.int64())), *columns], names=_ASKED)

    return ask


def _answer(asked: pa.Table) -> pa.Table:
    """The document frequency of all that blocks ask for in a range of the hash, in the order of each request."""

    def read(name: str, kind: str) -> list[np.ndarray]:
        return [from_planes(x, kind) for x in asked.column(name).to_pylist()]

    steps = read("steps", "<u8")
    wide, narrow, own = np.concatenate([np.cumsum(s) for s in steps]), np.concatenate(read("narrow", "<u2")), np.concatenate(read("own", "<u4")).astype(np.uint64)
    at = np.cumsum([0, *map(len, steps)]).tolist()
    df = sum_by_key(wide, narrow, own)
    found = pa.array([planes(df[i:j]) for i, j in zip(at, at[1:])], pa.binary())
    return pa.table([asked.column("block"), asked.column("part"), found], names=["block", "part", "df"])


def _rank_by_tfidf(key: str, top: int, size: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Ranks the phrases of a block of texts by the answers to what :func:`_ask` asked for it."""

    def rank(block: pa.Table, answers: pa.Table) -> pa.Table:
        found = _without_stop_words(block)
        order = np.argsort(found.hashed()[0], kind="stable")
        df = np.empty(len(order), np.int64)
        df[order] = np.concatenate([np.zeros(0, np.int64), *(from_planes(x, "<u8") for x in answers.sort_by("part").column("df").to_pylist())])
        frequencies, at = np.unique(df, return_inverse=True)
        weight = np.array([math.log((size + 1) / (n + 1)) for n in frequencies.tolist()])[at]
        text, phrase = found.text, found.phrase
        score = np.round(found.n / found.total[text] * weight[phrase], 6)
        group = pc.fill_null(block.column(key).combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)[text] + 1
        if len(np.unique(group)) < len(np.unique(text)):  # texts with the same key are ranked together
            together = np.lexsort((phrase, group))
            text, phrase, score, group = text[together], phrase[together], score[together], group[together]
        rows, place = best_rows(group, score, top)
        ids = block.column(key).take(pa.array(text[rows]))
        return pa.table([ids, found.strings(phrase[rows]), pa.array(score[rows]), pa.array(place.astype(np.int32))], names=[key, "phrase", "score", "place"])

    return rank


def keyphrases(docs: DataFrame, key: str = "doc_id", top: int = TOP_KEYWORDS) -> DataFrame:
    """Phrases without English stop words, ranked by TF-IDF (to six decimals) within each text, ties by phrase.

    Texts are dealt by key over blocks of about ``BLOCK_BYTES``. A block asks for the document frequency of each of its distinct phrases once,
    by 80 bits of hash; the requests are dealt by ranges of the hash, summed and answered in the same order. So a (text, phrase) pair is
    never a row, and the phrases of a block are counted where its texts are, before they ask and again to be ranked.
    """
    size, length = docs.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    blocks = max(cores, -(-(length or 0) // BLOCK_BYTES))
    parts = max(cores, blocks // 2)
    dealt = docs.select(key, _joined_tokens(F.col("text")).alias("tokens"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")).repartition(blocks, "block")
    asked = dealt.groupBy("block").applyInArrow(_ask(parts), "part long, block long, steps binary, narrow binary, own binary")
    answers = asked.repartition(parts, "part").groupBy("part").applyInArrow(_answer, "block long, part long, df binary").repartition(blocks, "block")
    kind = docs.schema[key].dataType.simpleString()
    ranked = dealt.groupBy("block").cogroup(answers.groupBy("block"))
    return ranked.applyInArrow(_rank_by_tfidf(key, top, size), f"{key} {kind}, phrase string, score double, place int")


def _sparse(vector: Column) -> Column:
    """The elements of a vector that aren't zero, with their places."""
    placed = F.transform(vector, lambda x, i: F.struct(i.alias("at"), x.cast("double").alias("x")))
    return F.filter(placed, lambda e: e["x"].isNull() | (e["x"] != 0))


def _sparse_dot(a: Column, b: Column) -> Column:
    """Inner product of a :func:`_sparse` vector and a whole one; zeros add nothing."""
    return F.aggregate(a, F.lit(0.0), lambda acc, e: acc + e["x"] * F.get(b, e["at"]).cast("double"))


def _nearest_by_digest(batch: pa.RecordBatch, texts: pa.Array, key: str, top: int) -> pa.RecordBatch:
    """:func:`keyphrases_by_embedding` of texts by whole counts of tokens in slots: a cosine is one division, and ties are exact."""
    words = Words(texts)
    names = words.vocabulary.cast(pa.binary()).to_pylist()
    slot = np.frombuffer(b"".join([hashlib.md5(w).digest()[:2] for w in names]), ">u2").astype(np.int64) % DIGEST_DIM
    counts = np.bincount(words.text * DIGEST_DIM + slot[words.word], minlength=len(texts) * DIGEST_DIM).reshape(-1, DIGEST_DIM)
    wanted = ~np.asarray(pc.is_in(words.vocabulary, _STOPPED)) & (np.asarray(pc.utf8_length(words.vocabulary)) > 1)
    found = Phrases(words.keep(wanted[words.word]))
    single = found.second < 0
    one, two = slot[found.first], slot[found.second]
    text, phrase = found.text, found.phrase
    inner = counts[text, one[phrase]] + np.where(single[phrase], 0, counts[text, two[phrase]])
    size = np.sqrt(np.where(single, 1, np.where(one == two, 4, 2)))
    score = np.round(inner / (np.sqrt((counts * counts).sum(1))[text] * size[phrase]), 6)
    rows, place = best_rows(text, score, top)
    return pa.RecordBatch.from_arrays(
        [batch.column(key).take(pa.array(text[rows])), found.strings(phrase[rows]), pa.array(score[rows]), pa.array(place.astype(np.int32))],
        names=[key, "phrase", "score", "place"],
    )


#: Adds ``embedding`` to texts named by the key columns: (rows, keys, text column).
Embedder = Callable[[DataFrame, list[str], str], DataFrame]


def keyphrases_by_embedding(docs: DataFrame, key: str = "doc_id", top: int = TOP_KEYWORDS, embedder: Embedder = digest_embedder) -> DataFrame:
    """Words and pairs of neighbouring words, without English stop words and single characters, whose vectors are nearest to the text's.

    ``score`` is the cosine, to six decimals, ties by phrase. Phrases and texts without a usable vector have none. The digest embedder's
    vectors follow from the tokens, so each text is done in its row and nothing is shuffled. By any other embedder each distinct phrase is
    embedded once, whatever number of texts has it, and so is each text; a phrase travels to its texts as the places of its vector
    that aren't zero.
    """
    if embedder is digest_embedder:
        kind = docs.schema[key].dataType.simpleString()

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in text_slices(batch, "tokens"):
                    yield _nearest_by_digest(part, texts, key, top)

        return docs.select(key, _joined_tokens(F.col("text")).alias("tokens")).mapInArrow(nearest, f"{key} {kind}, phrase string, score double, place int")
    tokens = F.filter(search_tokens(F.col("text")), lambda t: ~t.isin(STOP_WORDS) & (F.length(t) > 1))
    found = phrase_counts(docs, key, tokens).select(key, "phrase")
    vector = F.col("embedding")
    phrases = embedder(found.select("phrase").distinct(), ["phrase"], "phrase").select("phrase", _sparse(vector).alias("of_phrase"), norm(vector).alias("phrase_norm"))
    texts = embedder(docs.select(key, "text"), [key], "text").select(key, vector.alias("of_text"), norm(vector).alias("text_norm"))
    pairs = found.join(phrases, "phrase").join(texts, key)
    score = round_even(F.try_divide(_sparse_dot(F.col("of_phrase"), F.col("of_text")), F.col("phrase_norm") * F.col("text_norm")), 6)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "phrase"))
    scored = pairs.select(key, "phrase", score.alias("score")).where(F.col("score").isNotNull())
    return scored.withColumn("place", place).where(F.col("place") <= top)


def entity_rollup(mentions: DataFrame, key: str = "doc_id", top: int = TOP_ENTITIES) -> DataFrame:
    """First distinct (text, label) mentions of each item in sorted order."""
    place = Window.partitionBy(key).orderBy("mention", "label")
    return (
        mentions.select(key, "mention", "label")
        .distinct()
        .withColumn("place", F.row_number().over(place))
        .where(F.col("place") <= top)
    )
