"""Approximate nearest vectors by short codes of all rows, with the best candidates ranked again on their full vectors.

A vector of unit length is cut into ``parts``; each part is replaced by the number of the nearest of 256 centres of that part, so a row is
``parts`` bytes. The centres are fitted to a bounded sample of the rows (``SAMPLE_ROWS``, those of least key hash), but every row gets a code. A query is
scored against the codes of all rows, and only its ``candidates`` best are looked up with their full vectors. How many those are is measured once, on a
sample of rows taken as queries, and stored with the codes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelmill.functions.columns import dot, norm, round_even
from reelmill.operators.search import KEYS, SCORE_DIGITS, _topk_batch, _visible, semantic_topk_batch

PARTS, CENTRES = 16, 256
#: Rows that the centres are fitted to, and rows taken as queries to measure how many candidates are needed.
SAMPLE_ROWS, SAMPLE_QUERIES = 1 << 16, 64
ROUNDS = 10
#: Recall on the sample that decides the number of candidates, and the share of all rows that may be candidates.
AIM, MOST_SHARE = 0.97, 0.08


@dataclass
class Codebook:
    """Centres of each part of a unit vector; the parts of uneven widths lie one after another."""

    centres: list[np.ndarray]

    @property
    def bounds(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([c.shape[1] for c in self.centres])])

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """One byte for each part of each vector."""
        at = self.bounds
        columns = [_nearest(vectors[:, i:j], c) for i, j, c in zip(at[:-1], at[1:], self.centres)]
        return np.stack(columns, axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, k]] for k, c in enumerate(self.centres)], axis=1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1, length)


def _centres(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """At most ``n`` means of the rows of ``x`` by Lloyd's rounds, from different rows at first."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= n:
        return distinct
    c = distinct[np.sort(rng.choice(len(distinct), n, replace=False))]
    for _ in range(ROUNDS):
        own = _nearest(x, c)
        size = np.bincount(own, minlength=n)
        total = np.stack([np.bincount(own, x[:, k], n) for k in range(x.shape[1])], axis=1)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def fit_codebook(segments: DataFrame, parts: int = PARTS, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Codebook:
    """Centres from the ``sample_rows`` rows of least key hash (a bounded part of any table)."""
    some = _usable(segments).orderBy(F.xxhash64(*KEYS), *KEYS).limit(sample_rows).select("embedding").toPandas()
    if some.empty:
        return Codebook([np.zeros((1, 1))])
    x, rng = _unit(np.stack(some["embedding"].to_numpy()).astype(np.float64)), np.random.default_rng(seed)
    return Codebook([_centres(p, CENTRES, rng) for p in np.array_split(x, min(parts, x.shape[1]), axis=1)])


def _usable(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))


def encode_rows(segments: DataFrame, book: Codebook) -> DataFrame:
    """``video_no``, ``seg_index``, ``status`` and the ``code`` of every row with a usable vector."""

    @F.pandas_udf("binary")
    def code(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series(dtype=object)
        rows = book.encode(_unit(np.stack(vectors.to_numpy()).astype(np.float64)))
        return pd.Series([r.tobytes() for r in rows])

    return _usable(segments).select(*KEYS, "status", code("embedding").alias("code"))


def code_candidates(codes: DataFrame, book: Codebook, queries: DataFrame, candidates: int) -> DataFrame:
    """The ``candidates`` rows of each query (``query_no``, ``vector``) with the best scores by their codes, and their ``place``."""

    def read(pdf: pd.DataFrame) -> np.ndarray:
        return book.decode(np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), -1))

    return _topk_batch(codes, queries, candidates, [], column="code", read=read)


def code_topk(codes: DataFrame, book: Codebook, segments: DataFrame, queries: DataFrame, k: int, candidates: int) -> DataFrame:
    """Approximate top-k of each query: its candidates by code, ranked by the cosine with their full vectors."""
    found = code_candidates(codes, book, queries, candidates).select("query_no", *KEYS)
    full = found.join(segments.select(*KEYS, "embedding"), KEYS).join(queries.select("query_no", "vector"), "query_no")
    cosine = dot(F.col("embedding"), F.col("vector")) / (norm(F.col("embedding")) * norm(F.col("vector")))
    scored = full.select("query_no", *KEYS, round_even(cosine, SCORE_DIGITS).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("score"), *KEYS))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def needed_candidates(codes: DataFrame, book: Codebook, segments: DataFrame, k: int, aim: float = AIM, most_share: float = MOST_SHARE) -> int:
    """The fewest candidates with which rows taken as queries find ``aim`` of their exact top-k, ``most_share`` of all rows at most.

    Counted at once: each exact hit is found as soon as its place by code is among the candidates.
    """
    own = _usable(_visible(segments))
    sample = own.orderBy(F.xxhash64(*KEYS, F.lit("query")), *KEYS).limit(SAMPLE_QUERIES).select(F.col("embedding").cast("array<double>").alias("vector"))
    rows = [(i, r["vector"]) for i, r in enumerate(sample.collect())]
    most = max(k, int(own.count() * most_share))
    if not rows:
        return most
    queries = segments.sparkSession.createDataFrame(rows, "query_no long, vector array<double>")
    exact = semantic_topk_batch(segments, queries, k).select("query_no", *KEYS)
    places = exact.join(code_candidates(codes, book, queries, most).withColumnRenamed("place", "by_code"), ["query_no", *KEYS], "left")
    counts = {r["by_code"]: r["n"] for r in places.groupBy("by_code").agg(F.count(F.lit(1)).alias("n")).collect()}
    found, total = 0, sum(counts.values())
    for place in range(1, most + 1):
        found += counts.get(place, 0)
        if found >= aim * total:
            return max(place, k)
    return most


def build_codes(segments: DataFrame, path: str, k: int = 10, parts: int = PARTS) -> str:
    """Fit, encode all rows and measure, once; ``path`` then holds ``codes``, ``centres`` and ``search`` (the number of candidates)."""
    spark = segments.sparkSession
    book = fit_codebook(segments, parts)
    encode_rows(segments, book).write.parquet(f"{path}/codes")
    centres = [(p, n, [float(v) for v in c]) for p, part in enumerate(book.centres) for n, c in enumerate(part)]
    spark.createDataFrame(centres, "part int, number int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    needed = needed_candidates(spark.read.parquet(f"{path}/codes"), book, segments, k)
    spark.createDataFrame([(needed,)], "candidates int").coalesce(1).write.parquet(f"{path}/search")
    return path


def open_codes(spark: SparkSession, path: str) -> tuple[DataFrame, Codebook, int]:
    """Codes, codebook (at most ``PARTS`` * 256 rows) and number of candidates of a folder of :func:`build_codes`."""
    parts: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/centres").orderBy("part", "number").collect():
        parts.setdefault(r["part"], []).append(r["centre"])
    candidates = spark.read.parquet(f"{path}/search").first()["candidates"]
    return spark.read.parquet(f"{path}/codes"), Codebook([np.array(parts[p]) for p in sorted(parts)]), candidates
