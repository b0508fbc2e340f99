"""Benchmark passages in documents, by the q-gram lemma.

Texts are normalised first: A to Z (and the capital letters of Latin-1) as small ones, every run of other ASCII signs than letters
and digits as one space. An occurrence of an item of length L with at most k edits shares at least L + 1 - q(k + 1) q-grams with
it, and their diagonals (place in the document less place in the item) span at most k. So the shared q-grams are counted in
overlapping bands of 2(k + 1) diagonals, every k + 1; the bands that reach the bound are kept, and a banded alignment of the item
against the document decides.

An item's budget k is a share of its length (10 %), less where the bound would fall under 1. An item of fewer than q bytes after
normalising has no q-gram: it matches as whole words, without edits. Items that nothing is left of, null ones among them, match nothing; so
do null and empty documents. Equal items each get their rows, and so do
repeated documents.

The benchmark is a query set: it is broadcast in blocks of bounded size, and each block is compared with all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.llm.arrow import slices, text_bytes
from reelmill.llm.words import KEEP, LOWER, ODD

GRAM = 8
EDIT_SHARE = 0.1
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 4 << 20
#: Items in a block.
BLOCK_ITEMS = 1 << 18
#: Pairs of documents and items that are numbered together, so that a pair and its diagonal fit 63 bits.
PAIRS = 1 << 31
#: Shared q-grams looked at together.
HITS = 4_000_000
#: Counters in a dense table of documents and items.
DENSE = 8_000_000

WORD = np.zeros(256, bool)
WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
WORD[128:] = True


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, where each text begins and ends in them, and the place in ``data`` that each came from."""
    low = LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    after = after[(low[after] >= 0x80) & (low[after] <= 0x9E) & (low[after] != 0x97)]
    low[after] += 0x20
    solid = WORD[low]
    before = np.zeros(len(low), bool)
    before[1:] = solid[:-1]
    starts = offsets[:-1]
    before[starts[starts < len(low)]] = False
    kept = np.flatnonzero(solid | before)
    out = low[kept]
    out[~solid[kept]] = 32
    return out, np.searchsorted(kept, offsets), kept


def grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a number; the last 7 places hold zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", padded, strides=(1,)).copy()


@dataclass
class Block:
    """Normalised items with an index of their q-grams."""

    ids: list
    data: np.ndarray
    offsets: np.ndarray
    budget: np.ndarray
    least: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    maybe: np.ndarray
    shift: int
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: items too short for a q-gram, as numbers in order, and which they are

    @classmethod
    def of(cls, ids: list, texts: pa.Array, share: float) -> Block:
        data, offsets, _ = normalise(*text_bytes(texts))
        ends = np.array([e - (e > s and data[e - 1] == 32) for s, e in zip(offsets[:-1], offsets[1:])], np.int64)
        size = ends - offsets[:-1]
        budget = np.minimum(np.floor(size * share), np.maximum((size - GRAM) // GRAM, 0)).astype(np.int64)
        least = np.maximum(size + 1 - GRAM * (budget + 1), 1)
        all_grams = grams(data)
        item = np.repeat(np.arange(len(size)), np.maximum(size - GRAM + 1, 0))
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(max(n - GRAM + 1, 0)) for n in size)]).astype(np.int64)
        key = all_grams[offsets[:-1][item] + place]
        order = np.argsort(key, kind="stable")
        gram, first = np.unique(key[order], return_index=True)
        bits = max(12, int(np.ceil(np.log2(max(len(gram), 1) * 16))))
        maybe = np.zeros(1 << bits, bool)
        maybe[(gram * ODD[0]) >> np.uint64(64 - bits)] = True
        short = {}
        for n in range(1, GRAM):
            own = np.flatnonzero(size == n)
            number = all_grams[offsets[:-1][own]] & KEEP[n] if len(own) else np.zeros(0, np.uint64)
            sort = np.argsort(number, kind="stable")
            if len(own):
                short[n] = number[sort], own[sort]
        offsets = np.append(offsets[:-1], offsets[-1])
        return cls(ids, data, offsets, budget, least, gram, np.append(first, len(key)), item[order], place[order], maybe, 64 - bits, short)

    def text(self, i: int) -> np.ndarray:
        e = self.offsets[i + 1]
        return self.data[self.offsets[i] : e - (e > self.offsets[i] and self.data[e - 1] == 32)]


def align(item: np.ndarray, windows: np.ndarray, anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between ``item`` and a part of each window (a row), and the band offset where that part ends.

    The part may begin at any of the first W places, W being the window's length less the item's; if ``anchored``, at the first
    place, and each place left out counts as an edit.
    """
    width = windows.shape[1] - len(item)
    kind = np.int16 if width + len(item) < 1 << 15 else np.int32  # no count is larger than both together
    step = np.arange(width, dtype=kind)
    best = np.tile(step, (len(windows), 1)) if anchored else np.zeros((len(windows), width), kind)
    for i, sign in enumerate(item):
        new = best + (windows[:, i : i + width] != sign)
        new[:, :-1] = np.minimum(new[:, :-1], best[:, 1:] + 1)
        best = np.minimum.accumulate(new - step, axis=1) + step
    at = best.argmin(axis=1)
    return best[np.arange(len(best)), at].astype(np.int64), at


def window(data: np.ndarray, low: int, high: int, start: int, end: int) -> np.ndarray:
    """Bytes ``start`` to ``end`` of the document that lies from ``low`` to ``high``, zeros outside it."""
    out = np.zeros(end - start, np.uint8)
    a, b = max(start, low), min(end, high)
    if a < b:
        out[a - start : b - start] = data[a:b]
    return out


def shared_grams(block: Block, data: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Equal q-grams inside the documents that ``row`` numbers: (place in ``data``, item, place in the item), in bounded portions."""
    g = grams(data)
    at = np.flatnonzero(block.maybe[(g * ODD[0]) >> np.uint64(block.shift)])
    at = at[at + GRAM <= len(data)]
    at = at[row[at] == row[at + GRAM - 1]]
    k = np.minimum(np.searchsorted(block.gram, g[at]), len(block.gram) - 1)
    found = block.gram[k] == g[at]
    at, k = at[found], k[found]
    many = block.first[k + 1] - block.first[k]
    ends = np.cumsum(many)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + HITS, "right")))
        n = many[i:j]
        posting = np.repeat(block.first[k[i:j]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield np.repeat(at[i:j], n), block.item[posting], block.place[posting]
        i = j


def whole_words(block: Block, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, item, first byte, end byte) of the first place where each item without a q-gram stands between word ends in each text."""
    if not block.short:
        return []
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    begins = data != 32
    begins[1:] &= (data[:-1] == 32) | (row[1:] != row[:-1])
    at = np.flatnonzero(begins)
    g = grams(data)[at]
    out = []
    for n, (number, item) in block.short.items():
        end = at + n
        inside = end <= offsets[row[at] + 1]
        inside &= (end == offsets[row[at] + 1]) | (data[np.minimum(end, len(data) - 1)] == 32)
        key = g & KEEP[n]
        low, high = (np.searchsorted(number, key, side) for side in ("left", "right"))
        many = np.where(inside, high - low, 0)
        hit = np.repeat(np.arange(len(at)), many)
        which = item[np.arange(len(hit)) + np.repeat(low - (np.cumsum(many) - many), many)]
        _, first = np.unique(row[at[hit]] * len(block.ids) + which, return_index=True)
        out += [(int(row[at[h]]), int(i), int(at[h]), int(at[h]) + n) for h, i in zip(hit[first], which[first])]
    return out


def find(block: Block, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, first byte, end byte) of the best occurrence of each item in each text that holds it."""
    n_rows = max(1, (PAIRS - 1) // max(len(block.ids), 1))
    if len(texts) > n_rows:
        return [(r + low, *rest) for low in range(0, len(texts), n_rows) for r, *rest in find(block, texts.slice(low, n_rows))]
    raw, raw_offsets = text_bytes(texts)
    data, offsets, origin = normalise(raw, raw_offsets)
    n_items = len(block.ids)
    if not len(data):
        return []
    out = [(r, i, 0, int(origin[s]), int(origin[e - 1]) + 1) for r, i, s, e in whole_words(block, data, offsets)]
    if not len(block.gram):
        return out
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    dense = len(texts) * n_items <= DENSE
    total = np.zeros(len(texts) * n_items if dense else 0, np.int64)
    if dense:  # a pair of document and item that shares too few q-grams anywhere needs no bands
        for place, item, _ in shared_grams(block, data, row):
            total += np.bincount(row[place].astype(np.int64) * n_items + item, minlength=len(total))
    cells: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for place, item, inner in shared_grams(block, data, row):
        pair = row[place].astype(np.int64) * n_items + item
        if dense:
            many = total[pair] >= block.least[item]
            place, item, inner, pair = place[many], item[many], inner[many], pair[many]
        diagonal = place - offsets[row[place]] - inner + len(block.data)  # never negative
        key, number = np.unique(pair << 32 | diagonal // (block.budget[item] + 1), return_counts=True)
        cells.append(key)
        counts.append(number)
    if not cells:
        return out
    key, inverse = np.unique(np.concatenate(cells), return_inverse=True)
    number = np.bincount(inverse, np.concatenate(counts), len(key)).astype(np.int64)
    # a band is a cell and the next one: bands of 2(k + 1) diagonals that overlap by half
    start = np.unique(np.concatenate([key, key - 1]))
    start = start[(start & 0xFFFFFFFF) != 0xFFFFFFFF]

    def at(k: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(key, k), len(key) - 1)
        return np.where(key[i] == k, number[i], 0)

    item = (start >> 32) % n_items
    total = at(start) + at(start + 1)
    good = total >= block.least[item]
    start, item = start[good], item[good]
    doc, band = (start >> 32) // n_items, start & 0xFFFFFFFF
    for i in np.unique(item):
        text, k = block.text(i), int(block.budget[i])
        width = 2 * (k + 1) + 2 * k
        here = np.flatnonzero(item == i)
        for part in np.array_split(here, max(1, len(here) * (len(text) + width) // 20_000_000)):
            d = doc[part]
            base = offsets[d] + band[part] * (k + 1) - len(block.data) - k
            rows = np.stack([window(data, offsets[a], offsets[a + 1], b, b + len(text) + width) for a, b in zip(d, base)])
            edits, off = align(text, rows)
            end = base + len(text) + off
            for a in np.unique(d):
                own = np.flatnonzero((d == a) & (edits <= k))
                if len(own):
                    best = own[np.lexsort((end[own], edits[own]))[0]]
                    e = int(end[best])
                    # from its end backwards, to learn where the occurrence begins
                    back = window(data, offsets[a], offsets[a + 1], e - len(text) - k - 1, e)[::-1]
                    _, over = align(text[::-1], back[None], anchored=True)
                    s = max(e - len(text) - int(over[0]), int(offsets[a]))
                    out.append((int(a), int(i), int(edits[best]), int(origin[s]), int(origin[min(e, offsets[a + 1]) - 1]) + 1))
    return out


def leaked_passages(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    share: float = EDIT_SHARE,
) -> DataFrame:
    """One row for each document and benchmark item that occurs in it within the edit budget: ``doc_id``, ``item_id``, ``edits``
    and ``budget`` (of the best occurrence, the first of equal ones), ``start_char``, ``end_char`` (code points of the document)."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("item_id", benchmark.schema[item_id].dataType),
            *(T.StructField(c, T.LongType()) for c in ("edits", "budget", "start_char", "end_char")),
        ]
    )
    found = None
    for shared in item_blocks(benchmark, item_id, item_text):
        part = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(finder(shared, share, schema), schema)
        found = part if found is None else found.unionByName(part)
    return found


def item_blocks(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator:
    """The benchmark as broadcasts of about ``BLOCK_BYTES`` and ``BLOCK_ITEMS`` at most, of which there is one even if it is empty."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    size, number = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.count("t")).first()
    n_blocks = max(-(-size // BLOCK_BYTES), -(-number // BLOCK_ITEMS), 1)
    for b in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("t", "i"), F.lit(n_blocks)) == b) if n_blocks > 1 else items
        got = own.orderBy("i", "t").toArrow()
        yield spark.sparkContext.broadcast((got.column("i").to_pylist(), got.column("t").to_pylist()))


def finder(shared, share: float, schema: T.StructType):
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items = shared.value
        block = Block.of(ids, pa.array(items, pa.string()), share)
        for batch in batches:
            for part, texts in slices(batch, "t"):
                rows = sorted(find(block, texts))
                raw, offsets = text_bytes(texts)
                chars = [[np.count_nonzero((raw[offsets[r] : x] & 0xC0) != 0x80) for x in (s, e)] for r, _, _, s, e in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("d").take(pa.array([r[0] for r in rows], pa.int64())),
                        pa.array([ids[r[1]] for r in rows], None if rows else pa.null()).cast(arrow_type(ids)),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([int(block.budget[r[1]]) for r in rows], pa.int64()),
                        pa.array([c[0] for c in chars], pa.int64()),
                        pa.array([c[1] for c in chars], pa.int64()),
                    ],
                    names=names,
                )

    return run


def arrow_type(ids: list) -> pa.DataType:
    return pa.array(ids).type if any(x is not None for x in ids) else pa.int64()


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item. Rows are judged where they lie, so no text is shuffled."""

    def judge(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, items = shared.value
            block = Block.of(ids, pa.array(items, pa.string()), share)
            for batch in batches:
                for part, texts in slices(batch, text):
                    good = np.ones(len(texts), bool)
                    good[[r[0] for r in find(block, texts)]] = False
                    yield part.filter(pa.array(good))

        return run

    for shared in item_blocks(benchmark, item_id, item_text):
        docs = docs.mapInArrow(judge(shared), docs.schema)
    return docs
