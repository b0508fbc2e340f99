"""Documents linked by the Jaccard likeness of their word n-grams, found by filtering under several global orders of the n-grams.

Two linked sets share some of their first few tokens under every order of all tokens, so a pair must pass under each:

* *Order of hashes, then of rarity.* Of the tokens that come first by hash (about twice the prefix length) linked sets share at least a known
  number, so of these only the rarest few are keys. Rarity is counted over all documents. A document most of whose first
  tokens are nowhere else has no keys and is done. Documents meet where they have a key in common.
* *Two other orders of hashes.* The tokens of both prefixes up to the nearer end are compared, and the rest of both sets bounds what they
  may share beyond it. Pairs that can't reach the likeness go.

What passes is verified on the full sets. Documents with equal sets are one class, and links are only looked for between classes. First each class
is compared with the least one of each key's group. Of groups that still hold several components, small ones are paired (components
that are connected already aside), and large ones are compared in blocks of bounded size, under an order of rarity within the blocks. So rows grow with the
documents and not with pairs of copies, no link between components is missed, and no task holds a whole group.

``A``-``Z`` count as small letters, words are runs without white space. A text of fewer words than a token is one token; null and empty texts have none
and are linked with nothing. Tokens are told apart by 64-bit hashes. Each row of an id that several rows have
stands for its own text; rows without an id share the component of their text (null if no linked text has an id). Other columns aren't looked at, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.llm.arrow import lists, slices, text_bytes
from reelmill.llm.components import components, roots
from reelmill.llm.store import forget, stored
from reelmill.llm.words import ODD, hash_words, mix, shingle_hashes

#: Members of a group that are paired one by one.
SMALL_GROUP = 24
#: Bytes of sets in one side of a block.
BLOCK_BYTES = 16 << 20
#: Partners of a set that are looked at one by one; more are counted together.
FEW = 24
#: Ids that may be broadcast (16 MB).
BROADCAST_IDS = 1 << 20
DIGEST_BYTES = 12


def least_overlap(n, percent: int):
    """Tokens that a set of ``n`` shares at least with a linked one."""
    return -(-percent * n // 100)


def prefix_length(n, percent: int):
    """Of so many tokens of a set of ``n`` at least one is in each linked set."""
    return n - least_overlap(n, percent) + 1


def certain(n, percent: int):
    """Tokens that linked sets share at least among the first :func:`first_length` of each, counted for the smaller set."""
    return np.minimum(prefix_length(n, percent), least_overlap(n, percent))


def first_length(n, percent: int):
    return np.minimum(n, prefix_length(n, percent) + certain(n, percent) - 1)


def pair_overlap(n, m, percent: int):
    """Tokens that sets of ``n`` and ``m`` share at least when they are linked."""
    return -(-percent * (n + m) // (100 + percent))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    return shingle_hashes(*hash_words(*text_bytes(texts)), words)


def first_of_each(values: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``count`` values of each run between ``at``, and where the shorter runs begin and end."""
    ends = np.concatenate([[0], np.cumsum(count)])
    return values[np.arange(ends[-1]) + np.repeat(at[:-1] - ends[:-1], count)], ends


def order_of(h: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """32-bit places of the tokens under another order, sorted within each set."""
    set_no = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    key = set_no << np.uint64(32) | mix(h * ODD[0] + np.uint64(seed)) >> np.uint64(32)
    key.sort()
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def digests(h: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    return [hashlib.blake2b(h[i:j].tobytes(), digest_size=DIGEST_BYTES).digest() if j > i else None for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def described(source: DataFrame, words: int, percent: int) -> DataFrame:
    """Of each row (``id``, ``t``): set size ``n``, ``digest``, the first tokens by hash, and the prefixes under two other orders."""
    schema = T.StructType([source.schema["id"], *T.StructType.fromDDL("n long, digest binary, first array<long>, p1 binary, p2 binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "t"):
                h, at = shingle_sets(texts, words)
                n = np.diff(at)
                full = n > 0
                first, ends = first_of_each(h, at, np.where(full, first_length(n, percent), 0))
                columns = [part.column("id"), pa.array(n), pa.array(digests(h, at), pa.binary()), lists(first.view(np.int64), ends)]
                for seed in (1, 2):
                    places, ends = first_of_each(order_of(h, at, seed), at, np.where(full, prefix_length(n, percent), 0))
                    raw, ends = places.tobytes(), 4 * ends
                    columns.append(pa.array([raw[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def rare_keys(classes: DataFrame, percent: int) -> DataFrame:
    """Rows (``token``, ``no``): the first tokens of each class that a linked class may have as its rarest common one."""
    tokens = classes.select(F.explode("first").alias("token"), "no", "n")
    common = tokens.groupBy("token").count().where("count > 1")
    shared = tokens.join(common, "token")
    by_class = Window.partitionBy("no")
    ranked = shared.withColumn("rank", F.row_number().over(by_class.orderBy("count", "token"))).withColumn("held", F.count("*").over(by_class))
    ranked = ranked.withColumn("o", F.expr(f"(n * {percent} + 99) div 100")).withColumn("p", F.expr(f"(o * {percent} + 99) div 100"))
    sure = F.least(F.col("o") - F.col("p") + 1, "p")  # `certain` of the least partner
    return ranked.where(F.col("rank") <= F.col("held") - sure + 1).select("token", "no")


def may_be_linked(x: np.ndarray, y: np.ndarray, n: int, m: int, percent: int) -> bool:
    """Whether the prefixes of two sets of ``n`` and ``m`` tokens under one order leave room for a link."""
    if not np.isin(x, y).any():
        return False
    ends = [v[-1] for v, size in ((x, n), (y, m)) if len(v) < size]
    if ends:  # what lies before the nearer end is known of both
        x, y = x[x < min(ends)], y[y < min(ends)]
    both = min(np.isin(x, y).sum(), np.isin(y, x).sum())
    return both + min(n - len(x), m - len(y)) >= pair_overlap(n, m, percent)


def filtered(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) that the sizes and both other orders allow."""
    side = lambda s: classes.select(F.col("no").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("n", "p1", "p2")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = list(zip(*(batch.column(c).to_pylist() for c in ("a_n", "b_n"))))
            good = np.ones(len(batch), bool)
            for order in ("p1", "p2"):
                sides = (batch.column(f"{s}_{order}").to_pylist() for s in "ab")
                for i, (x, y) in enumerate(zip(*sides)):
                    good[i] = good[i] and may_be_linked(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), *sizes[i], percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(run, pairs.schema)


def full_sets(source: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The full sets (``no``, ``set``) of the classes ``wanted`` (``no``, ``digest``, ``id`` of one of its rows)."""
    wanted = stored(wanted, "wanted")
    ids = wanted.select(F.col("id").alias("want")).distinct()
    few = wanted.count() <= BROADCAST_IDS
    texts = source.join(F.broadcast(ids) if few else ids, source["id"].eqNullSafe(F.col("want")), "left_semi").select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "t"):
                h, at = shingle_sets(texts, words)
                raw = [h[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(digests(h, at), pa.binary()), pa.array(raw, pa.binary())], names=["digest", "set"])

    made = texts.mapInArrow(run, "digest binary, set binary")
    keys = wanted.select("digest", "no")
    return made.join(F.broadcast(keys) if few else keys, "digest").groupBy("no").agg(F.any_value("set").alias("set"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(sets.select(F.col("no").alias("a"), F.col("set").alias("x")), "a")
    both = both.join(sets.select(F.col("no").alias("b"), F.col("set").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                good.append(len(np.intersect1d(p, q, assume_unique=True)) >= pair_overlap(len(p), len(q), percent))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, pairs.schema)


class Labels:
    """Labels of the members of a block, joined one by one."""

    def __init__(self, names: np.ndarray):
        self.names, self.own = np.unique(names, return_inverse=True)
        self.of_name = np.arange(len(self.names))

    def now(self) -> np.ndarray:
        return self.of_name[self.own]

    def join(self, x: int, y: int) -> None:
        a, b = self.of_name[self.own[x]], self.of_name[self.own[y]]
        self.of_name[self.of_name == max(a, b)] = min(a, b)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.of_name != np.arange(len(self.names)))
        return self.names[moved], self.names[self.of_name[moved]]


def block_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, names: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels that links between members of ``left`` and ``right`` connect, each with the least label it hangs together with.

    Tokens are ordered by their rarity in the block; sets meet where their prefixes do.
    """
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    order = np.lexsort((token, count[token], owner))
    token = token[order]
    at = np.concatenate([[0], np.cumsum(size)])
    labels = Labels(names)
    firsts, ends = first_of_each(token, at, prefix_length(size, percent))

    def by_token(values: np.ndarray, holder: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine = np.isin(holder, right)
        values, holder = values[mine], holder[mine]
        o = np.argsort(values, kind="stable")
        return values[o], holder[o]

    prefix_index = by_token(firsts, np.repeat(np.arange(len(sets)), np.diff(ends)))
    full_index = by_token(token, owner)

    def holders(index: tuple[np.ndarray, np.ndarray], tokens: np.ndarray) -> np.ndarray:
        low, high = (np.searchsorted(index[0], tokens, side) for side in ("left", "right"))
        n = high - low
        return index[1][np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    for x in left:
        near = np.bincount(holders(prefix_index, firsts[ends[x] : ends[x + 1]]), minlength=len(sets)) > 0
        near &= 100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x])
        now = labels.now()
        near = np.flatnonzero(near & (now != now[x]))
        if len(near) > FEW:
            shared = np.bincount(holders(full_index, token[at[x] : at[x + 1]]), minlength=len(sets))[near]
        else:
            shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in near], np.int64)
        for y in near[shared >= pair_overlap(size[near], size[x], percent)]:
            labels.join(x, y)
    return labels.links()


def in_large_groups(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of components (``a``, ``b``) connected by links within the large groups ``members`` (``token``, ``no``, ``component``).

    Groups that have a component in common are one cluster, so each pair meets once.
    """
    hubs = members.groupBy("token").agg(F.min("component").alias("b"))
    chained = members.select("token", F.col("component").alias("a")).distinct().join(hubs, "token").select("a", "b").distinct()
    clusters = components(chained).select(F.col("id").alias("component"), F.col("component").alias("cluster"))
    every = members.select("no", "component").distinct().join(clusters, "component").join(sets, "no")
    sizes = every.groupBy("cluster").agg(F.ceil(F.sum(F.length("set")) / BLOCK_BYTES).cast("int").alias("blocks"))
    dealt = every.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    dealt = dealt.withColumn("at", F.explode(others)).select("cluster", "at.i", "at.j", "own", "component", "set")

    def meet(key, group):
        own = np.asarray(group.column("own"))
        left, right = (np.flatnonzero(own == key[k].as_py()) for k in (1, 2))
        held = [np.frombuffer(s.as_py(), np.uint64) for s in group.column("set")]
        links = block_links(held, left, right, np.asarray(group.column("component")), percent)
        return pa.table({"a": pa.array(links[0], pa.int64()), "b": pa.array(links[1], pa.int64())})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(meet, "a long, b long")


def ngram_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles`` (set size), ``component_id`` (the least id reachable over links)."""
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    wide = stored(described(source, words, percent), "described")
    rows = stored(wide.select("id", "n", "digest"), "rows")
    some = [F.any_value(c).alias(c) for c in ("n", "first", "p1", "p2")]
    classes = wide.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), *some)
    classes = stored(classes.withColumn("no", F.monotonically_increasing_id()), "classes")
    forget(wide)

    # classes meet where they have a key in common; groups of the same members are one
    keys = stored(rare_keys(classes, percent), "keys")
    groups = keys.groupBy("token").agg(
        F.count("*").alias("m"), F.min("no").alias("least"), F.bit_xor(F.xxhash64("no")).alias("x"), F.bit_xor(F.xxhash64("no", F.lit(1))).alias("y")
    )
    groups = groups.where("m > 1").groupBy("m", "least", "x", "y").agg(F.min("token").alias("token"))
    members = stored(keys.join(groups.select("token", "m", "least"), "token"), "members")

    # each class against the least one of each of its groups
    stars = members.where("no <> least").select(F.col("no").alias("a"), F.col("least").alias("b")).distinct()
    stars = stored(filtered(stars, classes, percent).groupBy("a").agg(F.min("b").alias("b")), "stars")

    def sets_of(numbers: DataFrame) -> DataFrame:
        return stored(full_sets(source, classes.join(numbers.distinct(), "no").select("no", "digest", "id"), words), "sets")

    sets = sets_of(stars.select(F.col("a").alias("no")).union(stars.select("b")))
    links = stored(verified(stars, sets, percent), "links")
    forget(sets)
    label = roots(links).withColumnsRenamed({"id": "no"})

    # groups that still hold several components
    placed = members.join(label, "no", "left").withColumn("component", F.coalesce("component", "no"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("token")
    placed = stored(placed.join(mixed, "token").select("token", "no", "component", "m"), "placed")
    small = placed.where(F.col("m") <= SMALL_GROUP)
    one, two = (small.select("token", F.col("no").alias(s), F.col("component").alias(f"c_{s}")) for s in "ab")
    pairs = one.join(two, "token").where("a > b AND c_a <> c_b").select("a", "b").distinct()
    pairs = stored(filtered(pairs, classes, percent), "pairs")
    large = placed.where(F.col("m") > SMALL_GROUP)
    sets = sets_of(pairs.select(F.col("a").alias("no")).union(pairs.select("b")).union(large.select("no")))
    more = verified(pairs, sets, percent).unionByName(in_large_groups(large, sets, percent))
    last = components(stored(links.unionByName(more), "links")).withColumnsRenamed({"id": "no"})
    for table in (keys, members, stars, placed, pairs, sets):
        forget(table)

    named = classes.select("no", "digest", "id").join(last, "no", "left").withColumn("component", F.coalesce("component", "no"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least, "component").select("digest", "component_id")
    out = rows.join(named, "digest", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))

