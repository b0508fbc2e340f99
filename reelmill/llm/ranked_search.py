"""Ranked lexical search by reversed search: the items (queries) are indexed, and the documents stream through that index.

A term is a run of ASCII letters, digits and signs beyond ASCII; A to Z count as a to z. A block of items becomes an inverted index from
terms to items, of bounded size, which every task gets. One pass over the texts leaves, of each document, its length and the counts of
the terms that the index has; document frequencies are counted from those. In a second pass each task multiplies the counts through the
index and keeps one bounded heap per item; the heaps of all tasks are merged in two steps, so no task meets more than a few hundred of them.

Scores are whole numbers (see :func:`scores`). Equal scores are in the order of ``doc_id``, null before all others.

Null and empty texts have no terms: such a document is in no result and not in the number of documents, such an item has no result. Rows
of one ``item_id`` (null too) are one item with the terms of all of them. Rows of one ``doc_id`` are documents of their own, each with a
rank. Terms are told apart by 64-bit hashes. Other columns of both tables are not looked at, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.llm.arrow import lists, slices, text_bytes
from reelmill.llm.store import forget, stored
from reelmill.llm.words import LOWER, hash_words

#: Pairs of an item and a term in one broadcast index (16 bytes each); an item with more is a block of its own.
BLOCK_PAIRS = 1 << 20
#: Scores worked out at once in a task.
CELLS = 1 << 18
#: Heaps of one item that are merged in one group of the first step.
MERGED = 256
#: Sums below this are exact in doubles.
EXACT = 1 << 53

#: Bytes of terms in small letters, all others as a space.
TERM_BYTES = np.full(256, 32, np.uint8)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    TERM_BYTES[_low:_high] = LOWER[_low:_high]


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts in order, and the n + 1 places where each text's begin and end."""
    data, offsets = text_bytes(texts)
    return hash_words(TERM_BYTES[data], offsets)


def distinct_counts(text: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a text (as a place) and a term below ``n``, in order, and how often each occurs."""
    pair, count = np.unique(text * max(n, 1) + term, return_counts=True)
    return pair // max(n, 1), pair % max(n, 1), count


class Index:
    """Which items hold a term, for one block of items."""

    def __init__(self, items: list, pairs: list[tuple[int, int]]):
        self.items = items  # ids, by place
        place, term = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        self.terms, number = np.unique(term.view(np.uint64), return_inverse=True)
        self.holders = place[np.argsort(number, kind="stable")].astype(np.int32)
        self.holds = np.bincount(number, minlength=len(self.terms))
        self.start = np.concatenate([[0], np.cumsum(self.holds)])[:-1]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash among the terms, -1 for a term of no item."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)


def item_blocks(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[Index]:
    """The items in blocks of about ``limit`` pairs of an item and a term; the driver holds one block at a time."""
    source = items.select(F.col(item_id).alias("item"), F.col(text).alias("text"))
    schema = T.StructType([source.schema["item"], T.StructField("term", T.LongType())])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                h, at = terms_of(texts)
                owner = np.repeat(np.arange(len(texts)), np.diff(at))
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(owner)), pa.array(h.view(np.int64))], names=["item", "term"])

    every = stored(source.mapInArrow(pairs, schema).distinct(), "item-terms")
    ids, held = [], []
    for row in every.orderBy("item", "term").toLocalIterator():
        if not ids or ids[-1] != row.item:
            if len(held) >= limit:
                yield Index(ids, held)
                ids, held = [], []
            ids.append(row.item)
        held.append((len(ids) - 1, row.term))
    if held:
        yield Index(ids, held)
    forget(every)


def term_counts(docs: DataFrame, doc_id: str, text: str, shared) -> DataFrame:
    """Of each document ``id``, ``n`` (all its terms) and ``terms``, ``counts`` of those that the index has."""
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([source.schema["id"], *T.StructType.fromDDL("n long, terms array<int>, counts array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part, texts in slices(batch, "text"):
                h, at = terms_of(texts)
                number = index.numbers(h)
                known = np.flatnonzero(number >= 0)
                owner = np.repeat(np.arange(len(texts)), np.diff(at))[known]
                owner, term, count = distinct_counts(owner, number[known], len(index.terms))
                offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
                columns = [part.column("id"), pa.array(np.diff(at)), lists(term.astype(np.int32), offsets), lists(count.astype(np.int64), offsets)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def weights(frequency: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)


def length_norms(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """100 - 90 + (90 * n * documents) div terms, without overflow."""
    if int(n.max(initial=0)) * 90 * documents < 1 << 63:
        return 10 + 90 * n * documents // terms
    return np.array([10 + 90 * int(x) * documents // terms for x in n], np.int64)


def scores(index: Index, weight: np.ndarray, owner: np.ndarray, term: np.ndarray, count: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Scores of documents (rows) for all items (columns): the sum of w * ((10**9 * tf) div (1000 * tf + 8 * m)) over the item's terms.

    ``owner``, ``term`` and ``count`` are the terms of all the documents, ``norm`` is m of each document.
    """
    gain = weight[term] * (1_000_000_000 * count // (1000 * count + 8 * norm[owner]))
    holds = index.holds[term]
    place = np.arange(holds.sum()) + np.repeat(index.start[term] - (np.cumsum(holds) - holds), holds)
    cell = np.repeat(owner * len(index.items), holds) + index.holders[place]
    cells, gains = len(norm) * len(index.items), np.repeat(gain, holds)
    if float(weight.max(initial=0)) * 1e6 * len(index.terms) < EXACT:
        return np.bincount(cell, gains, cells).astype(np.int64).reshape(len(norm), -1)
    total = np.zeros(cells, np.int64)
    np.add.at(total, cell, gains)
    return total.reshape(len(norm), -1)


@functools.total_ordering
class Later:
    """An id that counts as less the later it comes in the order of ids; null ids come first of all."""

    def __init__(self, value):
        self.value = value

    def __eq__(self, other):
        return self.value == other.value

    def __lt__(self, other):
        if self.value is None or other.value is None:
            return self.value is not None and other.value is None
        return self.value > other.value


class Heaps:
    """The k best documents of each item, the worst of them on top."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # a score below this doesn't enter
        self.last = np.full(items, np.iinfo(np.int64).max)  # nor does an equal one of an id from this on

    def offer(self, score: np.ndarray, ids: pa.Array) -> None:
        numeric = pa.types.is_integer(ids.type)
        good = score >= self.least
        if numeric:
            number = np.asarray(pc.fill_null(ids.cast(pa.int64()), np.iinfo(np.int64).min))
            good &= (score > self.least) | (number[:, None] < self.last)
        rows, items = np.nonzero(good)
        if not len(rows):
            return
        names = ids.take(pa.array(rows)).to_pylist()
        for item, value, name in zip(items.tolist(), score[rows, items].tolist(), names):
            heap, entry = self.heaps[item], (value, Later(name))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            else:
                continue
            if len(heap) == self.k:
                self.least[item] = heap[0][0]
                if numeric and heap[0][1].value is not None:
                    self.last[item] = heap[0][1].value

    def rows(self) -> tuple[list[int], list[int], list]:
        flat = [(i, value, name.value) for i, heap in enumerate(self.heaps) for value, name in heap]
        return [x[0] for x in flat], [x[1] for x in flat], [x[2] for x in flat]


def best_of_tasks(counts: DataFrame, shared, weight: np.ndarray, documents: int, terms: int, k: int) -> DataFrame:
    """The heaps of each task as rows (``item`` as a place in the block, ``score``, ``id``)."""
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("score", T.LongType()), counts.schema["id"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        heaps, step, kind = Heaps(len(index.items), k), max(1, CELLS // len(index.items)), None
        for batch in batches:
            kind = batch.schema.field("id").type
            for low in range(0, len(batch), step):
                part = batch.slice(low, step)
                held = part.column("terms")
                owner = np.repeat(np.arange(len(part)), np.asarray(pc.list_value_length(held)))
                term, count = (np.asarray(pc.list_flatten(part.column(c))).astype(np.int64) for c in ("terms", "counts"))
                norm = length_norms(np.asarray(part.column("n")), documents, terms)
                heaps.offer(scores(index, weight, owner, term, count, norm), part.column("id"))
        if kind is not None:
            items, values, ids = heaps.rows()
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(values, pa.int64()), pa.array(ids, kind)], names=schema.names)

    return counts.where("size(terms) > 0").mapInArrow(run, schema)


def merged(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each item with their ``rank``, from the heaps of all tasks."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_first()]
    parts = hits.withColumn("part", F.floor(F.spark_partition_id() / MERGED))
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    whole = some.drop("rank", "part").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return whole.where(F.col("rank") <= k)


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """The ``k`` best documents of each item with a score above 0: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``."""
    spark = docs.sparkSession
    out = T.StructType([items.schema[item_id], T.StructField("rank", T.IntegerType()), docs.schema[doc_id], T.StructField("score", T.LongType())])
    names = ["item_id", "rank", "doc_id", "score"]
    result, corpus = spark.createDataFrame([], out).toDF(*names), None
    for index in item_blocks(items, item_id, item_text, block_pairs):
        shared = spark.sparkContext.broadcast(index)
        counts = stored(term_counts(docs, doc_id, text, shared), "term-counts")
        if corpus is None:
            corpus = counts.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # a row per term of the block at most
        frequency = np.zeros(len(index.terms), np.int64)
        for row in held:
            frequency[row.t] = row["count"]
        hits = merged(best_of_tasks(counts, shared, weights(frequency, corpus[0]), *corpus, k), k)
        places = spark.createDataFrame(list(enumerate(index.items)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", out[0].dataType)]))
        hits = hits.join(F.broadcast(places), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
        result = result.unionByName(stored(hits, "hits"))
        forget(counts)
        shared.unpersist()
    return result
