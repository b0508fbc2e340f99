"""Digests of documents from their improbable features.

Every window of 16 bytes, and in texts of 512 code points or more also every window of 64 bytes, gets the rank of its entropy's rarity:
the farther the entropy lies from that of usual text, the rarer. In each run of as many neighbouring windows the rarest (of equal ones
the leftmost) gains a vote, and windows with enough votes are the document's features. Their hashes go into Bloom filters of 2048 bits,
five bits each; a filter that has taken its 160 features is closed and the next one of the chain begun. A digest is the chain of the
16-byte windows, followed by that of the 64-byte windows and that of runs (below) if there is one; the first byte of each filter's row says which it belongs to.

A text without such a window (shorter than one, or all of near-constant bytes), and every text whose runs of 4 bytes fit one filter, has a
chain of its distinct runs of 4 bytes too (of fewer bytes: of itself), so that short and monotonous texts have features as well.

Two digests are compared by the widest windows that both have, so that texts on either side of a limit can be alike. Their
likeness is the mean, over the filters of the shorter chain (of both in turn, if they are of one length), of the best overlap of set bits with
a filter of the other chain, less what chance gives, from 0 to 1.

A null or empty text has no feature and the empty digest, which is like another empty one (1) and unlike all else (0). Ids are numbers:
others are refused where the order of ids matters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.llm.arrow import append_columns, slices, text_array, text_bytes
from reelmill.llm.words import ODD, mix

#: Code points from which a text has a chain of long windows too.
LONG = 512


class Windows(NamedTuple):
    """Bytes of a window, windows of a run, votes that make a feature, and the entropy of usual text in bits."""

    width: int
    run: int
    votes: int
    usual: float


OF_LONG, OF_SHORT = Windows(64, 64, 16, 4.2), Windows(16, 16, 4, 3.4)
#: Bytes of a run in texts without windows.
GRAM = 4
FILTER_BYTES, FEATURES_IN_FILTER, BITS_OF_FEATURE = 256, 160, 5
#: Windows of less entropy are no features.
LEAST = 1.0
#: Share of the way from chance to full overlap that counts as nothing.
MARGIN = 0.3
#: Bytes whose windows are counted together.
STRETCH = 1 << 16
SCALE = 1 << 20


def entropies(data: np.ndarray, width: int) -> np.ndarray:
    """Entropy in bits of the ``width`` bytes from each place on."""
    n = len(data) - width + 1
    c = np.arange(width + 1, dtype=np.float64)
    c[1:] *= np.log2(c[1:])
    weight = np.rint(c * SCALE).astype(np.int64)  # whole numbers, so that equal windows have equal sums however they are reached
    gain = np.diff(weight)
    out = np.empty(n, np.float64)
    for low in range(0, n, STRETCH):
        x = data[low : min(low + STRETCH, n) + width]
        ahead, behind = np.ones(len(x), np.uint8), np.ones(len(x), np.uint8)  # the same byte among the next, the last ones
        for d in range(1, width):
            same = (x[d:] == x[:-d]).view(np.uint8)
            ahead[:-d] += same
            behind[d:] += same
        m = min(STRETCH, n - low)
        start = weight[np.bincount(x[:width], minlength=256)].sum()
        step = gain[behind[width : width + m - 1] - 1] - gain[ahead[: m - 1] - 1]
        out[low : low + m] = np.concatenate([[start], start + np.cumsum(step)]) / (SCALE * width)
    return np.log2(width) - out


def features(data: np.ndarray, offsets: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct features of each text in order, and where each text's begin and end."""
    width, run, votes, usual = windows
    size = np.diff(offsets)
    doc = np.zeros(0, np.int64)
    place = np.zeros(0, np.int64)
    if len(data) >= width:
        h = entropies(data, width)
        row = np.repeat(np.arange(len(size)), size)[: len(h)]
        whole = np.arange(len(h)) + width <= offsets[1:][row]
        rank = np.clip(900 - np.rint(np.abs(h - usual) * 200), 0, 999).astype(np.int64)
        rank[~whole | (h < LEAST)] = 1000
        # no run reaches over two texts, since each text ends with width - 1 places where no window begins
        best = np.full(len(h) + 2 * (run - 1), 1000 << 40, np.int64)
        best[run - 1 : run - 1 + len(h)] = (rank << 40) | np.arange(len(h))
        span = 1
        while span < run:  # least of the next 2, 4, ... ranks
            best = np.minimum(best[: len(best) - span], best[span:])
            span *= 2
        best = best[(best >> 40) < 1000] & ((1 << 40) - 1)
        place = np.flatnonzero(np.bincount(best, minlength=len(h)) >= votes)
        doc = row[place]
    x = np.zeros(len(place), np.uint64)
    eight = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,)) if len(data) >= 8 else np.zeros(0, np.uint64)
    for k in range(0, width, 8):
        x = mix(x * ODD[0] ^ eight[place + k]) if len(place) else x
    by = np.lexsort((np.arange(len(x)), x, doc))
    first = np.ones(len(x), bool)
    first[1:] = (x[by][1:] != x[by][:-1]) | (doc[by][1:] != doc[by][:-1])
    new = np.sort(by[first])
    return x[new], np.searchsorted(doc[new], np.arange(len(size) + 1))


def distinct_runs(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of 4 bytes of the texts in ``rows`` (of the ``most`` first ones that each has), and the text of each, in order."""
    size = np.diff(offsets)[rows]
    count = np.where(size < GRAM, size > 0, size - GRAM + 1)
    count = count if most is None else np.minimum(count, most)
    text = np.repeat(np.arange(len(rows)), count)
    place = np.arange(count.sum()) + np.repeat(offsets[:-1][rows] - (np.cumsum(count) - count), count)
    padded = np.concatenate([data, np.zeros(GRAM, np.uint8)])
    run = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))[place].astype(np.uint64)
    short = np.flatnonzero(size[text] < GRAM)  # a text of fewer bytes is one run, told apart by its length
    length = size[text[short]].astype(np.uint64)
    run[short] = run[short] & ((np.uint64(1) << np.uint64(8) * length) - np.uint64(1)) | length << np.uint64(32)
    key = np.unique(text.astype(np.uint64) << np.uint64(34) | run)
    return key & np.uint64((1 << 34) - 1), rows[(key >> np.uint64(34)).astype(np.int64)]


def grams(data: np.ndarray, offsets: np.ndarray, windowless: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of 4 bytes of each text that is ``windowless`` or has few of them, and where each text's begin and end.

    A text whose first runs alone are too many to fit a filter isn't looked at any further.
    """
    n = len(offsets) - 1
    _, text = distinct_runs(data, offsets, np.arange(n), 2 * FEATURES_IN_FILTER)
    run, text = distinct_runs(data, offsets, np.flatnonzero(windowless | (np.bincount(text, minlength=n) <= FEATURES_IN_FILTER)))
    kept = (windowless | (np.bincount(text, minlength=n) <= FEATURES_IN_FILTER))[text]
    return mix(run[kept] ^ ODD[1]), np.searchsorted(text[kept], np.arange(n + 1))


def chains(x: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """The chain of filters of each text's features: rows of the window's width and 256 bytes."""
    count = np.diff(at)
    chain = -(-count // FEATURES_IN_FILTER)
    start = np.concatenate([[0], np.cumsum(chain)])
    doc = np.repeat(np.arange(len(count)), count)
    number = start[:-1][doc] + (np.arange(len(x)) - at[:-1][doc]) // FEATURES_IN_FILTER
    filters = np.zeros(start[-1] * FILTER_BYTES, np.uint8)
    for k in range(BITS_OF_FEATURE):
        bit = ((x >> np.uint64(11 * k)) & np.uint64(2047)).astype(np.int64)
        np.bitwise_or.at(filters, number * FILTER_BYTES + (bit >> 3), (1 << (bit & 7)).astype(np.uint8))
    filters = np.insert(filters.reshape(-1, FILTER_BYTES), 0, width, axis=1)
    return [filters[i:j] for i, j in zip(start[:-1], start[1:])]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """How like two digests are, 0 to 1, by the widest windows that both have."""
    for width in (OF_LONG.width, OF_SHORT.width, GRAM):
        x, y = a[a[:, 0] == width, 1:], b[b[:, 0] == width, 1:]
        if len(x) and len(y):
            return chain_likeness(x, y)
    return float(len(a) == len(b) == 0)


def chain_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """How like two chains of filters of one window width are, 0 to 1."""
    if len(a) > len(b):
        a, b = b, a
    x, y = np.unpackbits(a, axis=1), np.unpackbits(b, axis=1)
    m, n = x.sum(axis=1, dtype=np.int64), y.sum(axis=1, dtype=np.int64)
    if len(a) == len(b) == 1:
        shared = np.array([[np.count_nonzero(x & y)]], np.float64)
    else:
        shared = x.astype(np.float32) @ y.astype(np.float32).T
    most = np.minimum(m[:, None], n[None])
    floor = np.outer(m, n) / (8 * FILTER_BYTES)
    floor = floor + MARGIN * (most - floor)
    score = np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1)
    of_a, of_b = (score.max(axis=1) * m).sum() / m.sum(), (score.max(axis=0) * n).sum() / n.sum()
    return float((of_a + of_b) / 2 if len(a) == len(b) else of_a)


def fingerprint_text(digest: np.ndarray) -> str:
    return digest.tobytes().hex()


def fingerprints(texts: pa.Array) -> list[np.ndarray]:
    """The digest of each text: rows of 257 bytes, a window width and a filter."""
    data, offsets = text_bytes(texts)
    x, at = features(data, offsets, OF_SHORT)
    out = chains(x, at, OF_SHORT.width)
    rows = np.flatnonzero(np.asarray(pc.utf8_length(texts)) >= LONG)
    for i, chain in zip(rows, chains(*features(*text_bytes(texts.take(pa.array(rows))), OF_LONG), OF_LONG.width)):
        out[i] = np.concatenate([out[i], chain])
    runs = chains(*grams(data, offsets, np.diff(at) == 0), GRAM)
    return [np.concatenate([a, b]) if len(b) else a for a, b in zip(out, runs)]


def add_fingerprint(df: DataFrame, text: str = "text", fingerprint: str = "fingerprint") -> DataFrame:
    """``df`` with the digest of each text in hexadecimal; an input column called as the result is replaced."""

    def work(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([fingerprint_text(c) for c in fingerprints(texts)], pa.string())]

    return append_columns(df, text, f"`{fingerprint}` string", lambda: work)


def in_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` dealt over ranges of ids (``bucket``), sorted in each, with the first document of the next range at each range's end
    (``extra``), so that every document's follower stands behind it. After the last document the first one stands.

    Only the limits of the ranges and their least ids pass through the driver. Equal ids are ordered by text.
    """
    if not isinstance(docs.schema[doc_id].dataType, T.NumericType):
        raise TypeError(f"the ids in {doc_id!r} must be numbers")
    base = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("t"))
    n = 4 * max(1, docs.rdd.getNumPartitions())
    limits = base.where("id is not null").approxQuantile("id", [i / n for i in range(n + 1)], 0.25 / n)
    cuts = np.unique(np.array(limits[1:-1], np.float64))

    def numbered(ids):
        return pd.Series(np.searchsorted(cuts, ids.astype("float64").fillna(-np.inf), "left").astype("int32"))

    range_of = F.pandas_udf(numbered, "int")
    ranged = base.withColumn("bucket", range_of("id"))
    least = {r["bucket"]: r["id"] for r in base.select("id").withColumn("bucket", range_of("id")).groupBy("bucket").agg(F.min("id").alias("id")).collect()}
    some = sorted(least)
    if not some:
        return ranged.withColumn("extra", F.lit(False))
    before = {least[b]: some[i - 1] for i, b in enumerate(some)}  # the range that each range's first document follows
    spark = docs.sparkSession
    schema = T.StructType([base.schema["id"], T.StructField("bucket", T.IntegerType())])
    heads = spark.createDataFrame([(k, v) for k, v in before.items()], schema)
    first = base.join(F.broadcast(heads), base["id"].eqNullSafe(heads["id"])).groupBy("bucket", base["id"]).agg(F.min("t").alias("t"))
    both = ranged.withColumn("extra", F.lit(False)).unionByName(first.select("id", "t", "bucket", F.lit(True).alias("extra")))
    return both.repartition("bucket").sortWithinPartitions("bucket", "extra", "id", "t")


def edited(text: str, follower: str) -> str:
    """The text with its last quarter replaced by as much of the follower's beginning."""
    k = len(text) // 4
    return text[: len(text) - k] + follower[:k]


def compare_with_edit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` (to
    the edited text) and ``near_next`` (to the next document by id)."""
    ordered = in_order(docs, doc_id, text)
    added = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *T.StructType.fromDDL(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, whose follower isn't known yet
        for batch in batches:
            for part, _ in slices(batch, "t"):
                if held is not None:
                    part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                held = part.slice(part.num_rows - 1)
                if part.num_rows > 1:
                    yield described(part)

    def described(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_array(part.column("t"))
        own = texts.to_pylist()
        digests = fingerprints(texts)
        changed = [edited(a, b) for a, b in zip(own, own[1:])]
        other = fingerprints(pa.array(changed, pa.string()))
        rows = np.flatnonzero(~np.asarray(part.column("extra"))[:-1])
        columns = [
            pa.array([len(own[i]) for i in rows], pa.int64()),
            pa.array([hashlib.sha256(changed[i].encode()).hexdigest() for i in rows], pa.string()),
            pa.array([fingerprint_text(digests[i]) for i in rows], pa.string()),
            pa.array([fingerprint_text(other[i]) for i in rows], pa.string()),
            pa.array([likeness(digests[i], other[i]) for i in rows], pa.float64()),
            pa.array([likeness(digests[i], digests[i + 1]) for i in rows], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows)), *columns], names=schema.names)

    return ordered.select("id", "t", "extra").mapInArrow(run, schema)
