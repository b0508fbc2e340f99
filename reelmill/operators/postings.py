"""Stored postings of a segment table, so that a keyword search reads the terms it asks for and no text.

The folder of an index holds, as Parquet, ``postings`` (``term``, segment, ``tf``, ``len``, generation; in folders by a hash of the term and
sorted by term), ``lengths`` (tokens of each segment), ``replaced`` (videos whose older rows no longer count) and ``stats`` (corpus size of each
generation). An update names its videos as replaced and appends their new rows; it reads none of the old postings. Building the index anew
in another folder is how to get rid of replaced rows. A term that is in most segments lies in as many files as its folder has parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.functions.columns import round_even
from reelmill.operators.search import BM25_B, BM25_K1, KEYS, SCORE_DIGITS, _visible, query_terms

BUCKETS = 64
# Segments of which the postings of one bucket are written by one task.
PART_SEGMENTS, MOST_PARTS = 100_000, 256
# Tokens that are counted at once.
TOKENS_AT_ONCE = 1 << 18


def bucket_of(term: str, buckets: int = BUCKETS) -> int:
    """Where the postings of ``term`` lie: the driver-side twin of the ``bucket`` column."""
    return zlib.crc32(term.encode()) % buckets


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of segments with their ``tokens`` to one row per segment and term, in batches of about ``TOKENS_AT_ONCE`` tokens."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // TOKENS_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
        for first, end in zip(cuts[:-1], cuts[1:], strict=True):
            rows = batch.slice(first, end - first)
            words = rows.column("tokens").flatten()
            there = words.is_valid().to_numpy(zero_copy_only=False)
            words = words.dictionary_encode()
            if isinstance(words, pa.ChunkedArray):
                words = words.combine_chunks()
            row = np.repeat(np.arange(end - first), sizes[first:end])[there]
            code = words.indices.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            width = max(1, len(words.dictionary))
            found, tf = np.unique(row * width + code, return_counts=True)
            row = pa.array(found // width)
            columns = [words.dictionary.take(pa.array(found % width)), *[rows.column(k).take(row) for k in KEYS]]
            columns += [pa.array(tf.astype(np.int32)), rows.column("len").take(row)]
            yield pa.RecordBatch.from_arrays(columns, ["term", *KEYS, "tf", "len"])


def _postings(segments: DataFrame, generation: int, buckets: int) -> DataFrame:
    """One row per segment and term. All tokens of a segment come from its one row, so they are counted there and nothing is shuffled."""
    kinds = ", ".join(f"{k} {segments.schema[k].dataType.simpleString()}" for k in KEYS)
    listed = segments.select(*KEYS, F.size("tokens").alias("len"), "tokens")
    counted = listed.mapInArrow(_term_counts, f"term string, {kinds}, tf int, len int")
    return counted.select("term", *KEYS, "tf", "len", F.lit(generation).alias("gen"), F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(buckets)).cast("int").alias("bucket"))


def _append(segments: DataFrame, path: str, generation: int, buckets: int, parts: int | None) -> None:
    live = _visible(segments)
    parts = parts or min(MOST_PARTS, 1 + segments.count() // PART_SEGMENTS)
    by = ["bucket", F.pmod(F.xxhash64(*KEYS), F.lit(parts))]
    postings = _postings(live, generation, buckets)
    # a large index has a task for each part of a bucket, whose postings are sorted in memory
    dealt = postings.repartition(buckets * parts, *by) if parts > 1 else postings.repartition(*by)
    dealt.sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
    live.select(*KEYS, F.size("tokens").alias("len"), F.lit(generation).alias("gen")).write.mode("append").parquet(f"{path}/lengths")


def _finished(spark: SparkSession, path: str) -> list[int]:
    """Generations that were written to the end, the newest last: one per update."""
    return sorted(r["gen"] for r in spark.read.parquet(f"{path}/stats").select("gen").collect())


def _current(rows: DataFrame, path: str, finished: list[int]) -> DataFrame:
    """Rows of finished generations that no later finished one replaces."""
    replaced = rows.sparkSession.read.parquet(f"{path}/replaced").where(F.col("since").isin(finished))
    replaced = replaced.groupBy("video_no").agg(F.max("since").alias("since"))
    old = (rows["video_no"] == replaced["video_no"]) & (rows["gen"] < replaced["since"])
    return rows.where(F.col("gen").isin(finished)).join(replaced, old, "left_anti")


def _finish(spark: SparkSession, path: str, generation: int, finished: list[int]) -> None:
    """Write the corpus size of a generation, which makes its rows count."""
    lengths = _current(spark.read.parquet(f"{path}/lengths"), path, [*finished, generation])
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"))
    stats.withColumn("gen", F.lit(generation)).coalesce(1).write.mode("append").parquet(f"{path}/stats")


def build_index(segments: DataFrame, path: str, buckets: int = BUCKETS, parts: int | None = None) -> str:
    """Index the visible segments (``video_no``, ``seg_index``, ``status``, ``tokens``) in a new folder ``path``.

    ``parts`` tasks share a bucket, so that no task writes all postings of a frequent term; by default more of them the more segments there are.
    """
    segments.select("video_no", F.lit(0).alias("since")).limit(0).write.parquet(f"{path}/replaced")
    _append(segments, path, 0, buckets, parts)
    _finish(segments.sparkSession, path, 0, [])
    return path


def update_index(segments: DataFrame, path: str, gone: DataFrame | None = None, buckets: int = BUCKETS, parts: int | None = None) -> None:
    """Replace all rows of the videos in ``segments`` by these, and drop those of the videos in ``gone`` (``video_no``).

    The new rows count once the last step is done, all at the same moment; what a failed update left is never read. One update at a time.
    """
    spark = segments.sparkSession
    finished = _finished(spark, path)
    begun = [spark.read.parquet(f"{path}/{t}").agg(F.max(c)).first()[0] for t, c in (("lengths", "gen"), ("replaced", "since"))]
    generation = max(x for x in (*begun, *finished) if x is not None) + 1
    videos = segments.select("video_no")
    videos = (videos if gone is None else videos.unionByName(gone.select("video_no"))).distinct()
    videos.select("video_no", F.lit(generation).alias("since")).write.mode("append").parquet(f"{path}/replaced")
    _append(segments, path, generation, buckets, parts)
    _finish(spark, path, generation, finished)


def term_postings(spark: SparkSession, path: str, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Current postings of ``terms``: only the folders of their buckets are read, and in them only blocks that may hold them."""
    keys = {f.name: f.dataType for f in spark.read.parquet(f"{path}/lengths").schema}  # an index without any term has no postings file
    fields = ", ".join(["term string", *[f"{k} {keys[k].simpleString()}" for k in KEYS], "tf int, len int, gen int, bucket int"])
    rows = spark.read.schema(fields).parquet(f"{path}/postings")
    wanted = F.col("bucket").isin(sorted({bucket_of(t, buckets) for t in terms})) & F.col("term").isin(terms)
    return _current(rows.where(wanted), path, _finished(spark, path))


def index_match(spark: SparkSession, path: str, query: str, buckets: int = BUCKETS) -> DataFrame:
    """Segments that hold every term of the query, with ``tf_0``, ``tf_1``, ... and ``len``; none for a query without terms."""
    terms = query_terms(query)
    found = term_postings(spark, path, terms, buckets).groupBy(*KEYS).agg(
        F.max("len").alias("len"), *[F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf_{i}") for i, t in enumerate(terms)]
    )
    every = F.lit(bool(terms))
    for i in range(len(terms)):
        every = every & F.col(f"tf_{i}").isNotNull()
    return found.where(every)


def index_topk(spark: SparkSession, path: str, query: str, k: int, buckets: int = BUCKETS) -> DataFrame:
    """The ``k`` best segments by BM25 that hold every term: ``video_no``, ``seg_index``, ``score``; ties by segment."""
    terms = query_terms(query)
    corpus = spark.read.parquet(f"{path}/stats").orderBy(F.desc("gen")).first()
    counts = {r["term"]: r["n"] for r in term_postings(spark, path, terms, buckets).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    score: Column = F.lit(0.0)
    length = F.col("len") / F.lit(corpus["total"] / corpus["n"] if corpus["n"] else 1.0)
    for i, t in enumerate(terms):
        tf, df = F.col(f"tf_{i}"), counts.get(t, 0)
        idf = F.log(F.lit(1 + (corpus["n"] - df + 0.5) / (df + 0.5)))
        score = score + idf * (tf * (BM25_K1 + 1)) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length))
    scored = index_match(spark, path, query, buckets).select(*KEYS, round_even(score, SCORE_DIGITS).alias("score"))
    return scored.orderBy(F.desc("score"), *KEYS).limit(k)

