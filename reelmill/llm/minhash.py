"""Near-duplicate documents by circulant MinHash.

A document is its set of distinct shingles (runs of words). One permutation of 32-bit numbers shuffles the shingles, and a second
one, shifted on by one place for each coordinate, gives all signature coordinates (the least value of the set under each). The
coordinates are cut into bands; documents with an equal band are compared, and the exact Jaccard likeness of their full sets decides.

Documents with equal sets are one class, and only its least id is compared with others. First each document is compared exactly with
the least one that it meets in a few bands, and links make components. Then the components that meet in a bucket of any band and may
be alike are put into clusters: one byte of each coordinate tells pairs that are far too unlike apart (six standard deviations
below the threshold). In each cluster all documents that aren't linked yet are compared by their full sets, in blocks of bounded
size, so that no pair goes unexamined and no task holds a whole cluster. Of the pairs that are alike only as many are passed on as
it takes to connect them, so the rows grow with the documents, not with the pairs.

``A``-``Z`` count as small letters, words are runs without white space. A text of fewer words than a shingle is one shingle; null and
empty texts have none, are linked with nothing, and stay. Rows with one id are one document in several versions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.llm.arrow import append_columns, slices, text_bytes
from reelmill.llm.components import components, roots
from reelmill.llm.store import forget, stored
from reelmill.llm.words import hash_words, mix, shingle_hashes

BANDS, COORDINATES = 32, 160
#: Chance that a pair just at the threshold shares no band.
MISSED = 1e-6
#: Shingles permuted together.
CHUNK = 1 << 15
#: Bands in which a document's first partner is looked for.
FIRST_BANDS = 4
#: Members of a bucket or cluster compared with as many others in one step.
BLOCK = 256
#: Ids that may be broadcast (16 MB).
BROADCAST_IDS = 1 << 20


def band_rows(likeness: float) -> int:
    """Coordinates in a band: the most that miss a pair of this likeness at most with chance ``MISSED``."""
    fit = [r for r in range(1, COORDINATES // BANDS + 1) if (1 - likeness**r) ** BANDS <= MISSED]
    return max(fit, default=1)


def permute(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of coordinates for the sets of shingle hashes between ``at``, none of them empty."""
    out = np.empty((len(at) - 1, COORDINATES), np.uint32)
    low = 0
    while low < len(out):
        high = max(low + 1, int(np.searchsorted(at, at[low] + CHUNK, "right")) - 1)
        first = (mix(h[at[low] : at[high]]) >> np.uint64(32)).astype(np.uint32)
        starts = at[low:high] - at[low]
        for k in range(COORDINATES):
            out[low:high, k] = np.minimum.reduceat(permute(first + np.uint32(k)), starts)
        low = high
    return out


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    return shingle_hashes(*hash_words(*text_bytes(texts)), words)


def describe(texts: pa.Array, words: int, rows: int) -> list[pa.Array]:
    """Set size, digest of the set, band hashes and one byte of each coordinate, for each text."""
    h, at = shingle_sets(texts, words)
    size = np.diff(at)
    full = np.flatnonzero(size)
    sig = signatures(h, np.append(at[full], at[-1])) if len(full) else np.zeros((0, COORDINATES), np.uint32)
    bands = np.zeros((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(sig), b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) ^ sig[:, k])
        bands[:, b] = x
    digests: list[bytes | None] = [None] * len(size)
    sketch: list[bytes | None] = [None] * len(size)
    band: list[np.ndarray | None] = [None] * len(size)
    tail = (sig & np.uint32(255)).astype(np.uint8)
    for i, d in enumerate(full):
        digests[d] = hashlib.blake2b(h[at[d] : at[d + 1]].tobytes(), digest_size=16).digest()
        sketch[d] = tail[i].tobytes()
        band[d] = bands[i].view(np.int64)
    return [pa.array(size, pa.int64()), pa.array(digests, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]


def described(docs: DataFrame, doc_id: str, text: str, words: int, rows: int) -> DataFrame:
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    schema = T.StructType([source.schema["id"], *T.StructType.fromDDL("n long, digest binary, bands array<long>, sketch binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([part.column("id"), *describe(texts, words, rows)], names=schema.names)

    return source.mapInArrow(run, schema)


def sketch_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


class Merged:
    """Labels that are joined one by one."""

    def __init__(self, labels: pa.Array):
        self.names, place = np.unique(np.array(labels.to_pylist(), object), return_inverse=True)
        self.label, self.first = place, place.copy()  # of each row, as places in the sorted names

    def join(self, x: int, y: int) -> None:
        a, b = self.label[x], self.label[y]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)

    def links(self, kind: pa.DataType) -> pa.Table:
        """Each label that was joined to a smaller one, with the least label of all that it was joined with."""
        pairs = {(own, now) for own, now in zip(self.first, self.label) if own != now}
        sides = [[self.names[p[k]] for p in pairs] for k in (0, 1)]
        return pa.Table.from_arrays([pa.array(x, kind) for x in sides], names=["a", "b"])


def pair_schema(members: DataFrame) -> T.StructType:
    kind = members.schema["component"].dataType
    return T.StructType([T.StructField("a", kind), T.StructField("b", kind)])


def in_blocks(members: DataFrame, group: str) -> DataFrame:
    """Members (``component``, ``id`` and more) of groups of several components, copied to the block pairs (``i``, ``j``) in which they meet
    others; ``own`` is a member's block.

    Members of a group's largest component needn't be compared among themselves. The others are dealt over blocks of about BLOCK, each of
    which meets every other (``j`` from 0 on) and every block of the largest component (``j`` below 0).
    """
    parts = members.groupBy(group, "component").agg(F.count("*").alias("m"))
    sizes = parts.groupBy(group).agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("all"))
    blocks = sizes.select(
        group, F.col("top.component").alias("largest"),
        F.ceil(F.col("top.m") / BLOCK).cast("int").alias("many"), F.ceil((F.col("all") - F.col("top.m")) / BLOCK).cast("int").alias("few"),
    ).where("few > 0")
    dealt = members.join(blocks, group).withColumn("large", F.col("component") == F.col("largest"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("large"), F.col("many")).otherwise(F.col("few"))).cast("int"))
    own, few, many = F.col("own"), F.sequence(F.lit(0), F.col("few") - 1), F.sequence(F.lit(0), F.col("many") - 1)
    to_few = F.transform(few, lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    to_many = F.transform(many, lambda k: F.struct(own.alias("i"), (-1 - k).alias("j")))
    from_many = F.transform(few, lambda k: F.struct(k.alias("i"), (-1 - own).alias("j")))
    dealt = dealt.withColumn("at", F.explode(F.when(F.col("large"), from_many).otherwise(F.concat(to_few, to_many))))
    return dealt.select(group, "at.i", "at.j", F.when(F.col("large"), -1 - own).otherwise(own).alias("own"), *[c for c in members.columns if c != group])


def sketch_links(members: DataFrame, floor: float, least: float) -> DataFrame:
    """Pairs of components (``a``, ``b``) of members (``bucket``, ``component``, ``id``, ``n``, ``sketch``) of one bucket which are alike by
    their sketches. Of a group's components that hang together each is paired with the least one only."""

    def meet(key, group):
        sketch, n = sketch_matrix(group.column("sketch").combine_chunks()), np.asarray(group.column("n"), np.float64)
        own, merged = np.asarray(group.column("own")), Merged(group.column("component"))
        left, right = (np.flatnonzero(own == key[k].as_py()) for k in (1, 2))
        for x in left:
            y = right[(merged.label[right] != merged.label[x]) & (np.minimum(n[right], n[x]) >= least * np.maximum(n[right], n[x]))]
            for z in y[(sketch[y] == sketch[x]).mean(axis=1) >= floor] if len(y) else ():
                merged.join(x, z)
        return merged.links(group.schema.field("component").type)

    return in_blocks(members, "bucket").groupBy("bucket", "i", "j").applyInArrow(meet, pair_schema(members))


def shingle_table(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """The full shingle sets (``id``, ``set``) of the documents in ``wanted`` (``id``)."""
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    few = wanted.count() <= BROADCAST_IDS
    source = source.join(F.broadcast(wanted) if few else wanted, "id", "left_semi")
    schema = T.StructType([source.schema["id"], T.StructField("set", T.BinaryType())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "t"):
                h, at = shingle_sets(texts, words)
                raw = [h[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(raw, pa.binary())], names=["id", "set"])

    return source.mapInArrow(sets, schema)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets have 100 * intersection >= ``percent`` * union."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(compare, T.StructType([pairs.schema["a"], pairs.schema["b"]]))


def cluster_links(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of components of each cluster (``cluster``, ``component``, ``id``, ``set``) that are linked by the full sets, as in
    :func:`sketch_links`."""

    def meet(key, group):
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("set")]
        size = np.array([len(x) for x in sets])
        own, merged = np.asarray(group.column("own")), Merged(group.column("component"))
        left, right = (np.flatnonzero(own == key[k].as_py()) for k in (1, 2))
        every = np.concatenate([np.zeros(0, np.uint64), *(sets[y] for y in right)])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], np.repeat(right, size[right])[order]
        for x in left:
            low, high = (np.searchsorted(every, sets[x], side) for side in ("left", "right"))
            n = high - low
            hits = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared = np.bincount(owner[hits], minlength=len(sets))
            alike = (shared > 0) & (100 * shared >= percent * (size + size[x] - shared))
            for y in np.flatnonzero(alike):
                merged.join(x, y)
        return merged.links(group.schema.field("component").type)

    return in_blocks(members, "cluster").groupBy("cluster", "i", "j").applyInArrow(meet, pair_schema(members))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` (the least id reachable over links) and ``kept`` (whether
    it is that one)."""
    likeness = percent / 100
    floor = likeness - 6 * math.sqrt(likeness * (1 - likeness) / COORDINATES)
    all_docs = stored(described(docs, doc_id, text, words, band_rows(likeness)), "described")
    full = all_docs.where("n > 0")
    # documents with equal sets are one class; any of its rows has the class's bands
    classes = stored(full.groupBy("digest").agg(F.min("id").alias("id")), "classes")
    leaders = full.join(classes, ["digest", "id"]).dropDuplicates(["digest", "id"])
    leaders = stored(leaders.select("id", "n", "sketch", "bands"), "leaders")

    # first, each document against the least one that it meets in a few bands
    members = leaders.select("id", F.explode(F.slice("bands", 1, FIRST_BANDS)).alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count("*").alias("m")).where("m > 1")
    star = members.join(buckets, "bucket").groupBy("id").agg(F.min("pivot").alias("b")).where("id <> b")
    star = stored(star.select(F.col("id").alias("a"), "b"), "star")
    ends = star.select(F.col("a").alias("id")).union(star.select("b")).distinct()
    sets = stored(shingle_table(docs, stored(ends, "ends"), doc_id, text, words), "sets")
    links = stored(confirmed(star, sets, percent), "links")
    forget(sets)
    first = roots(links)

    # then, over all bands, components that meet in a bucket and may be alike are put into clusters
    placed = leaders.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    everywhere = placed.select("id", "component", F.explode("bands").alias("bucket"))
    mixed = everywhere.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("bucket")
    meeting = stored(everywhere.join(mixed, "bucket").distinct(), "meeting")
    maybe = sketch_links(meeting.join(leaders.select("id", "n", "sketch"), "id"), floor, likeness)
    clusters = components(stored(maybe.distinct(), "maybe")).withColumnsRenamed({"component": "cluster", "id": "component"})
    forget(meeting)

    # and in each cluster all that isn't linked yet is compared by the full sets
    open_ones = stored(placed.select("id", "component").join(clusters, "component"), "open")
    sets = stored(shingle_table(docs, open_ones.select("id").distinct(), doc_id, text, words).dropDuplicates(["id", "set"]), "sets")
    more = stored(cluster_links(open_ones.join(sets, "id"), percent).distinct(), "links")
    forget(sets)
    last = components(more).withColumnsRenamed({"component": "last", "id": "component"})

    named = classes.join(placed.select("id", "component").distinct(), "id", "left").join(last, "component", "left")
    named = named.select("digest", F.coalesce("last", "component", "id").alias("component_id"))
    out = all_docs.select("id", "n", "digest").join(named, "digest", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates; rows without an id stay.

    Rows of one id stay together: of those with equal sets of shingles one stays, of those without words one of each text.
    """
    kept = near_duplicates(docs, doc_id, text, words, percent).where("kept").select(F.col("doc_id").alias(doc_id)).distinct()
    version = next(n for n in map("version{}".format, range(len(docs.columns) + 1)) if n not in {c.lower() for c in docs.columns})

    def work(texts: pa.Array) -> list[pa.Array]:
        h, at = shingle_sets(texts, words)
        raw = [h[i:j].tobytes() or (t or "").encode() for i, j, t in zip(at[:-1], at[1:], texts.to_pylist())]
        return [pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary())]

    named = append_columns(docs.join(kept, doc_id, "left_semi"), text, f"{version} binary", lambda: work)
    return named.dropDuplicates([doc_id, version]).select(docs.columns).unionByName(docs.where(F.col(doc_id).isNull()))
