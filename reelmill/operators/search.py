"""Semantic, keyword and hybrid search over a segment table.

Segments carry ``video_no``, ``seg_index``, ``status`` of their video, ``embedding`` and ``tokens``. Deleted items never match.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from reelmill.functions.columns import clock_label, once, round_even, search_tokens
from reelmill.functions.vectors import cosine_to
from reelmill.schemas import GATE_ABS_FLOOR, GATE_REL_RATIO, RRF_K, SEARCH_LIMIT_MAX

KEYS = ["video_no", "seg_index"]
HIT_FIELDS = ["start_sec", "end_sec", "topic", "subject", "grade_level", "summary", "source_name"]
SCORE_DIGITS = 6
# Queries scored in one pass over the segments; more queries take more passes.
BATCH_QUERIES = 4096
# What a task holds at once: scores of a batch of rows, best rows of its queries, and rows that groups of queries go over.
TILE_SCORES, KEPT_ROWS, HELD_ROWS = 1 << 21, 1 << 20, 1 << 18
BM25_K1, BM25_B = 1.2, 0.75


def _visible(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("status") != "soft_deleted")


def attribute_filter(
    segments: DataFrame,
    subject: str | None = None,
    grade: str | None = None,
    has_speech: bool | None = None,
    content_type: str | None = None,
) -> DataFrame:
    """Exact-match filters applied before any ranking."""
    for col, value in (("subject", subject), ("grade_level", grade), ("has_speech", has_speech), ("content_type", content_type)):
        if value is not None:
            segments = segments.where(F.col(col) == value)
    return segments


def checked_limit(limit: int) -> int:
    """``limit`` itself, refused outside 1 to ``SEARCH_LIMIT_MAX``."""
    if not 1 <= limit <= SEARCH_LIMIT_MAX:
        raise ValueError(f"limit must be from 1 to {SEARCH_LIMIT_MAX}")
    return limit


def semantic_scores(segments: DataFrame, query: Sequence[float]) -> DataFrame:
    """Score of every visible segment with a usable vector."""
    scored = _visible(segments).where(F.col("embedding").isNotNull())
    return scored.withColumn("score", round_even(cosine_to(F.col("embedding"), query), SCORE_DIGITS)).where(
        F.col("score").isNotNull()
    )


def semantic_topk(segments: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """Exact top-k by cosine similarity, ties by segment key. Each task keeps k rows; k rows reach the driver."""
    return semantic_scores(segments, query).orderBy(F.desc("score"), *KEYS).limit(k)


def semantic_topk_batch(segments: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact top-k for any number of queries (``query_no``, ``vector``).

    Queries go to the tasks in blocks of ``BATCH_QUERIES``. Each partition scores its vectors batch by batch and keeps k rows per query,
    so only k rows per query and partition are shuffled and no segment-query pair table exists.
    """
    return _topk_batch(segments, queries, k, [])


def _stacked(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["embedding"].to_numpy()).astype(np.float64)


def _topk_batch(
    segments: DataFrame, queries: DataFrame, k: int, lists: list[str], near=None, column: str = "embedding", read=_stacked
) -> DataFrame:
    """``read`` makes a matrix of vectors from a batch of rows with ``column``."""
    vectors = _visible(segments).where(F.col(column).isNotNull()).select(*KEYS, column, *lists)
    partial = None
    for block in _query_blocks(queries):
        best = vectors.mapInPandas(_best_of_partition(block, k, near, read), "video_no long, seg_index int, score double, query_no long")
        partial = best if partial is None else partial.unionByName(best)
    place = Window.partitionBy("query_no").orderBy(F.desc("score"), *KEYS)
    return partial.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def _query_blocks(queries: DataFrame) -> Iterator[list[Row]]:
    """Queries in order, in blocks; one empty block if there is none."""
    rows = queries.orderBy("query_no").toLocalIterator()
    block = list(islice(rows, BATCH_QUERIES))
    yield block
    while block := list(islice(rows, BATCH_QUERIES)):
        yield block


def _held(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[list[pd.DataFrame]]:
    """Batches in lists of about ``rows`` rows."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            yield held
            held, n = [], 0
    if held:
        yield held


def _best_of_partition(block: list[Row], k: int, near=None, read=_stacked):
    """``near`` gives for a matrix of queries and each list number whether the query looks into the list; without it each sees all.

    Scores are made in tiles of ``TILE_SCORES``. Where the ``k`` rows of all queries would be more than ``KEPT_ROWS``, rows are held
    ``HELD_ROWS`` at a time and the queries go over them one group after another.
    """
    ids = np.array([r["query_no"] for r in block])
    matrix = np.array([r["vector"] for r in block], dtype=np.float64)
    looks = near(matrix) if near and len(matrix) else None
    if len(matrix):
        lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = (matrix / np.where(lengths == 0, 1, lengths)).T
    group = max(1, KEPT_ROWS // k)

    def best_of(batches, queries):
        none = (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        kept = {q: none for q in queries}
        for pdf in batches:
            if pdf.empty or not len(queries):
                continue
            m = read(pdf)
            n = np.linalg.norm(m, axis=1)
            usable = n > 0
            m, video, seg = m[usable] / n[usable, None], *(pdf.loc[usable, c].to_numpy(np.int64) for c in KEYS)
            if looks is None:
                parts = [(np.arange(len(m)), queries)]
            else:
                number = pdf.loc[usable, "list_no"].to_numpy()
                parts = [(np.flatnonzero(number == x), queries[looks[queries, x]]) for x in np.unique(number)]
            for rows, asked in parts:
                if not len(rows) or not len(asked):
                    continue
                own, tile = (m[rows], video[rows], seg[rows]), max(1, TILE_SCORES // len(rows))
                for start in range(0, len(asked), tile):
                    keep_best(kept, asked[start : start + tile], *own)
        for q, (s, v, g) in kept.items():
            if len(s):
                yield pd.DataFrame({"video_no": v, "seg_index": g.astype(np.int32), "score": s, "query_no": ids[q]})

    def keep_best(kept, asked, m, video, seg):
        scores = np.round(m @ matrix[:, asked], SCORE_DIGITS)
        if len(scores) > k:  # everything that can still be among the k, ties included
            edges = np.partition(scores, -k, axis=0)[-k]
        else:
            edges = np.full(len(asked), -np.inf)
        for c, q in enumerate(asked):
            i = np.flatnonzero(scores[:, c] >= edges[c])
            s, v, g = (np.concatenate(both) for both in zip(kept[q], (scores[i, c], video[i], seg[i])))
            first = np.lexsort((g, v, -s))[:k]
            kept[q] = (s[first], v[first], g[first])

    def best_of_partition(batches):
        every = np.arange(len(ids))
        if group >= len(ids):
            yield from best_of(batches, every)
            return
        for held in _held(batches, HELD_ROWS):
            for start in range(0, len(ids), group):
                yield from best_of(held, every[start : start + group])

    return best_of_partition


def inverted_lists(segments: DataFrame, n_lists: int, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """Assign every vector to its nearest of ``n_lists`` centroids; returns rows with ``list_no`` and the centroids.

    Store the rows partitioned by ``list_no`` and a probe reads only the lists it scores.
    """
    rows = segments.where(F.col("embedding").isNotNull()).withColumn("_v", array_to_vector("embedding"))
    model = KMeans(k=n_lists, seed=seed, maxIter=10, featuresCol="_v", predictionCol="list_no").fit(rows)
    return model.transform(rows).drop("_v"), np.array(model.clusterCenters())


def nearest_lists(segments: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add ``list_no``, the place of the nearest of given ``centroids`` (the first of equally near ones)."""
    c = np.asarray(centroids, dtype=np.float64)

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series(dtype="int32")
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        return pd.Series(((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)).argmin(axis=1).astype("int32"))

    return segments.where(F.col("embedding").isNotNull()).withColumn("list_no", nearest("embedding"))


def ann_topk(lists: DataFrame, centroids: np.ndarray, query: Sequence[float], k: int, probes: int) -> DataFrame:
    """Approximate top-k: exact scores inside the ``probes`` lists nearest to the query; all lists give the exact answer."""
    nearest = np.argsort(((centroids - np.asarray(query)) ** 2).sum(axis=1), kind="stable")[:probes]
    return semantic_topk(lists.where(F.col("list_no").isin([int(i) for i in nearest])), query, k)


def _list_places(centroids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """For each vector the place of each list, from 0 on, by the distance of its centroid (the first of equally near ones first)."""
    far = np.stack([((centroids - v) ** 2).sum(axis=1) for v in vectors])
    return far.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")


def ann_topk_batch(lists: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """Approximate top-k for any number of queries (``query_no``, ``vector``), as :func:`semantic_topk_batch`: each query is scored
    against the rows of its ``probes`` nearest lists only. All lists give the exact answer."""
    c = np.asarray(centroids, dtype=np.float64)
    return _topk_batch(lists, queries, k, ["list_no"], lambda vectors: _list_places(c, vectors) < probes)


def probes_for_recall(lists: DataFrame, centroids: np.ndarray, queries: DataFrame, exact: DataFrame, least: float) -> int:
    """The fewest lists that a query must look into so that the mean recall over ``queries`` against their ``exact`` hits is ``least``.

    Counted at once for every number of lists: a hit is found as soon as its list is among those looked into.
    """
    c = np.asarray(centroids, dtype=np.float64)

    @F.pandas_udf("int")
    def place(number: pd.Series, vectors: pd.Series) -> pd.Series:
        if number.empty:
            return pd.Series(dtype="int32")
        places = _list_places(c, np.stack(vectors.to_numpy()).astype(np.float64))
        return pd.Series(places[np.arange(len(number)), number.to_numpy()].astype("int32"))

    hits = exact.select("query_no", *KEYS).join(lists.select(*KEYS, "list_no"), KEYS).join(queries, "query_no")
    counts = {r["p"]: r["n"] for r in hits.groupBy(place("list_no", "vector").alias("p")).agg(F.count("*").alias("n")).collect()}
    found, total = 0, sum(counts.values())
    for p in range(len(c)):
        found += counts.get(p, 0)
        if found >= least * total:
            return p + 1
    return len(c)


def recall_of_batch(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the ``exact`` hits of all queries that were ``found`` (one row)."""
    both = ["query_no", *KEYS]
    marked = exact.select(*both).join(found.select(*both, F.lit(1).alias("hit")), both, "left")
    return marked.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def recall_at_k(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    hits = exact.select(*KEYS).join(found.select(*KEYS), KEYS, "left_semi")
    return hits.agg((F.count(F.lit(1)) / k).alias("recall"))


def query_terms(query: str) -> list[str]:
    """Distinct search tokens of a query, in order: the driver-side twin of :func:`search_tokens`."""
    kept = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in query.lower())
    return list(dict.fromkeys(kept.split()))


def keyword_match(segments: DataFrame, query: str) -> DataFrame:
    """Segments containing every term of the query; a row-local test. A query without any term matches nothing."""
    terms = query_terms(query)
    if not terms:
        return segments.limit(0)
    hit = F.lit(True)
    for t in terms:
        hit = hit & F.array_contains("tokens", t)
    return _visible(segments).where(hit)


def _occurrences(tokens: str, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term))


def keyword_scores(segments: DataFrame, query: str) -> DataFrame:
    """BM25 of the matching segments. Corpus size, mean length and term frequencies come from one aggregate row."""
    terms = query_terms(query)
    if not terms:
        return segments.limit(0).withColumn("score", F.lit(0.0))
    docs = _visible(segments)
    stats = docs.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.size("tokens")).alias("avg_len"),
            *[F.count_if(F.array_contains("tokens", t)).alias(f"df_{i}") for i, t in enumerate(terms)],
        ).alias("stats")
    )
    matched = keyword_match(segments, query).withColumn("stats", stats.scalar())
    length = F.size("tokens") / F.col("stats.avg_len")
    total: Column = F.lit(0.0)
    for i, t in enumerate(terms):
        tf = _occurrences("tokens", t)
        df = F.col(f"stats.df_{i}")
        idf = F.log(1 + (F.col("stats.n") - df + 0.5) / (df + 0.5))
        total = total + idf * (tf * (BM25_K1 + 1)) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length))
    return matched.withColumn("score", round_even(total, SCORE_DIGITS)).drop("stats")


def keyword_topk(segments: DataFrame, query: str, k: int) -> DataFrame:
    return keyword_scores(segments, query).orderBy(F.desc("score"), *KEYS).limit(k)


#: A keyword ranking: of a query and a number of rows the best segments with their ``score``.
KeywordTopk = Callable[[str, int], DataFrame]


def hybrid_rrf(segments: DataFrame, query: str, vector: Sequence[float], k: int, keyword: KeywordTopk | None = None) -> DataFrame:
    """Reciprocal-rank fusion of both rankings, each cut to a pool of max(4k, 40) rows first.

    ``keyword`` ranks by stored postings; without it the tokens of ``segments`` are scanned.
    """
    keyword = keyword or functools.partial(keyword_topk, segments)
    pool = max(4 * k, 40)
    ranked = Window.orderBy(F.desc("score"), *KEYS)  # over at most `pool` rows

    def places(hits: DataFrame, col: str) -> DataFrame:
        return hits.select(*KEYS, F.row_number().over(ranked).alias(col))

    sem = places(semantic_topk(segments, vector, pool), "sem_rank").withColumn("kw_rank", F.lit(None).cast("int"))
    kw = places(keyword(query, pool), "kw_rank").withColumn("sem_rank", F.lit(None).cast("int"))
    fused = sem.unionByName(kw).groupBy(*KEYS).agg(F.max("sem_rank").alias("sem_rank"), F.max("kw_rank").alias("kw_rank"))
    part = [F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0)) for c in ("sem_rank", "kw_rank")]
    order = [F.desc("score"), F.asc_nulls_last("sem_rank"), F.asc_nulls_last("kw_rank")]
    return fused.withColumn("score", round_even(part[0] + part[1], SCORE_DIGITS)).orderBy(*order).limit(k)


def search(
    segments: DataFrame,
    query: str,
    mode: str = "semantic",
    k: int = 10,
    vector: Sequence[float] | None = None,
    keyword: KeywordTopk | None = None,
) -> DataFrame:
    """Dispatch by mode; unknown modes are semantic, and without a query vector the answer is (and says) keyword.

    ``keyword`` as in :func:`hybrid_rrf`.
    """
    k = checked_limit(k)
    if mode == "keyword" or vector is None:
        hits, used = (keyword or functools.partial(keyword_topk, segments))(query, k), "keyword"
    elif mode == "hybrid":
        hits, used = hybrid_rrf(segments, query, vector, k, keyword), "hybrid"
    else:
        hits, used = semantic_topk(segments, vector, k), "semantic"
    found = hits.select(*KEYS, F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(used).alias("mode"))
    return with_hit_fields(found, segments)


def with_hit_fields(hits: DataFrame, segments: DataFrame) -> DataFrame:
    """What a hit shows besides its score: times, topic, subject, grade, summary and source, as far as the segments have them.

    ``hits`` are at most ``SEARCH_LIMIT_MAX`` rows, so they are broadcast to the segments.
    """
    shown = segments.select(*KEYS, *[c for c in HIT_FIELDS if c in segments.columns])
    return shown.join(F.broadcast(hits), KEYS)


def relevance_gate(hits: DataFrame, min_score: float | None = None, semantic: bool = True) -> DataFrame:
    """Keep hits at or above the floor: given, else relative to the best hit (semantic), else 0. Adds ``relative``."""
    top = hits.agg(F.max("score").alias("top")).scalar()
    scored = hits.withColumn("top", top)
    if min_score is not None:
        floor = F.lit(float(min_score))
    elif semantic:
        floor = F.greatest(F.lit(GATE_ABS_FLOOR), F.col("top") * GATE_REL_RATIO)
    else:
        floor = F.lit(0.0)
    return (
        scored.where(F.col("score") >= floor)
        .withColumn("relative", round_even(F.try_divide("score", "top"), SCORE_DIGITS))
        .drop("top")
    )


def hit_labels(segments: DataFrame) -> DataFrame:
    """``m:ss-m:ss`` label of each segment."""
    return segments.select(
        *KEYS, F.concat(clock_label(F.col("start_sec")), F.lit("-"), clock_label(F.col("end_sec"))).alias("label")
    )


def with_tokens(segments: DataFrame) -> DataFrame:
    """Derived search column over transcript, summary and topic."""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("transcript_text", "summary", "topic")])
    return once(segments, "tokens", search_tokens(text))
