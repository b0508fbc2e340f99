"""Language-model scores of documents by deleted interpolation.

The model mixes maximum-likelihood estimates of word pairs, words and the uniform word:

    p(w | v) = a2(b) c(v, w) / c(v) + a1(b) c(w) / N + a0(b) / (V + 1),    b the frequency bucket (powers of two) of the context v.

The weights of each bucket are learned by expectation-maximisation on held-out counts: a tenth of the training documents is deleted
from the counts, and the mixture is fitted to its words. The final estimates count all training documents.

How counts reach the words that need them: texts are packed into blocks of bounded size. A block asks for each of its distinct words
and pairs (64-bit hashes, sorted, so that they can be told by their differences) once, with its own counts; the requests are dealt
by ranges of the hash, summed, and answered in the same order. So a word that a third of all rows hold costs one entry a block, and
no count table is ever whole in one place. The driver sees totals and a histogram of bounded size to fit the weights to.

A to Z are small letters, words are runs without white space, and every text ends with an end sign, which counts as a token and
stands before the first word. Null and empty texts are the end sign alone. A null id is in no fold and trains. Without any training
text all words are equally likely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.llm.arrow import text_array, text_bytes
from reelmill.llm.store import stored
from reelmill.llm.words import ODD, hash_words, mix

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Documents whose id's remainder (mod ``FOLDS``) is this one aren't learned from; those of the other are deleted to fit the weights.
FOLDS, HELD_OUT, DELETED = 10, 0, 1
BUCKETS = 40
#: Steps of the logarithm of a probability that the weights are fitted to, per factor of two.
FINE = 4
NOTHING = -10_000
EM_ROUNDS = 60
LEAST_WEIGHT = 1e-5
END = mix(np.array([0x656E64], np.uint64))[0]
WORDS, PAIRS = 0, 1


def packed_blocks(docs: DataFrame) -> DataFrame:
    """``docs`` (``id``, ``r``, ``t``) as rows (``block``, ``deleted``, ``pack``), a pack holding many documents compressed."""
    schema = "block string, deleted boolean, pack binary"

    def pack(rows: list[pa.RecordBatch]) -> bytes:
        table = pa.Table.from_batches(rows)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table.combine_chunks())
        return sink.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        waiting: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
        size = {False: 0, True: 0}

        def flush(deleted: bool) -> pa.RecordBatch:
            nonlocal made
            made += 1
            row = pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{made}"]), pa.array([deleted]), pa.array([pack(waiting[deleted])], pa.binary())],
                names=["block", "deleted", "pack"],
            )
            waiting[deleted], size[deleted] = [], 0
            return row

        for batch in batches:
            texts = text_array(batch.column("t"))
            batch = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("r"), texts], names=["id", "r", "t"])
            fold = np.asarray(batch.column("r")) == DELETED
            for deleted in (False, True):
                own = batch.filter(pa.array(fold == deleted))
                _, offsets = text_bytes(own.column("t"))
                low = 0
                while low < own.num_rows:
                    room = BLOCK_BYTES - size[deleted]
                    high = int(np.searchsorted(offsets, offsets[low] + room, "right")) - 1
                    if high <= low and waiting[deleted]:
                        yield flush(deleted)
                        continue
                    high = min(max(high, low + 1), own.num_rows)
                    waiting[deleted].append(own.slice(low, high - low))
                    size[deleted] += int(offsets[high] - offsets[low])
                    low = high
        for deleted in (False, True):
            if waiting[deleted]:
                yield flush(deleted)

    return docs.mapInArrow(run, schema)


class Block:
    """The tokens of a pack: each with its context (the token before it), its document, and its place among the distinct ones."""

    def __init__(self, pack: bytes):
        table = pa.ipc.open_stream(pack).read_all().combine_chunks()
        self.ids = table.column("id").combine_chunks()
        remainder = np.asarray(table.column("r"))
        words, at = hash_words(*text_bytes(text_array(table.column("t"))))
        n = np.diff(at)
        last = at[1:] + np.arange(len(n))  # where each document's end sign goes
        self.tokens = np.full(len(words) + len(n), END, np.uint64)
        is_word = np.ones(len(self.tokens), bool)
        is_word[last] = False
        self.tokens[is_word] = words
        context = np.empty_like(self.tokens)
        context[1:] = self.tokens[:-1]
        context[:1] = END
        self.doc = np.repeat(np.arange(len(n)), n + 1)
        self.count = n + 1
        self.held_out = remainder == HELD_OUT
        trains = (~self.held_out)[self.doc]
        deleted = (remainder == DELETED)[self.doc]
        self.keys: list[np.ndarray] = []
        self.place: list[np.ndarray] = []
        self.train: list[np.ndarray] = []
        self.deleted: list[np.ndarray] = []
        for values in (self.tokens, mix(context * ODD[0] ^ self.tokens)):
            keys, place = np.unique(values, return_inverse=True)
            self.keys.append(keys)
            self.place.append(place)
            self.train.append(np.bincount(place, trains, len(keys)).astype(np.int64))
            self.deleted.append(np.bincount(place, deleted, len(keys)).astype(np.int64))
        self.context_place = np.searchsorted(self.keys[WORDS], context)


def thin(values: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes each that hold the largest; the first byte says how many."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(values) or values.max() < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def thick(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def key_bytes(keys: np.ndarray) -> bytes:
    """Sorted hashes by their differences, in six bytes each where these are small enough."""
    step = np.diff(keys, prepend=np.uint64(0))
    first, step = step[:1].tobytes(), step[1:]
    if len(step) and step.max() >> np.uint64(48):
        return first + b"\x08" + step.tobytes()
    return first + b"\x06" + np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def bytes_key(raw: bytes) -> np.ndarray:
    first, width = np.frombuffer(raw[:8], "<u8"), raw[8]
    body = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    step = np.zeros((len(body), 8), np.uint8)
    step[:, :width] = body
    return np.cumsum(np.concatenate([first, step.reshape(-1).view("<u8")]), dtype=np.uint64)


def requests(blocks: DataFrame, bits: int) -> DataFrame:
    """What each block asks for: (``kind``, ``part`` of the hash range, ``block``, ``keys``, own counts ``train`` and ``deleted``)."""
    schema = "kind int, part long, block string, keys binary, train binary, gone binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, pack in zip(batch.column("block").to_pylist(), batch.column("pack")):
                block = Block(pack.as_py())
                for kind in (WORDS, PAIRS):
                    keys = block.keys[kind]
                    part = keys >> np.uint64(64 - bits)
                    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                    ends = np.append(starts[1:], len(keys))
                    rows = list(zip(starts, ends))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([kind] * len(rows), pa.int32()),
                            pa.array(part[starts].astype(np.int64)),
                            pa.array([name] * len(rows), pa.string()),
                            pa.array([key_bytes(keys[i:j]) for i, j in rows], pa.binary()),
                            pa.array([thin(block.train[kind][i:j]) for i, j in rows], pa.binary()),
                            pa.array([thin(block.deleted[kind][i:j]) for i, j in rows], pa.binary()),
                        ],
                        names=["kind", "part", "block", "keys", "train", "gone"],
                    )

    return blocks.select("block", "pack").mapInArrow(run, schema)


def answers(asked: DataFrame) -> DataFrame:
    """For each request the counts over all blocks in the order of its keys; one answer of each part also has the part's totals."""
    schema = "block string, kind int, part long, train binary, gone binary, tokens long, gone_tokens long, types long"

    def answer(key, group):
        raw = group.column("keys").to_pylist()
        keys = [bytes_key(k) for k in raw]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        train = np.bincount(place, np.concatenate([thick(x) for x in group.column("train").to_pylist()])).astype(np.int64)
        gone = np.bincount(place, np.concatenate([thick(x) for x in group.column("gone").to_pylist()])).astype(np.int64)
        at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        n = len(keys)
        words = key[0].as_py() == WORDS
        total = np.zeros((3, n), np.int64)
        total[:, 0] = (train.sum(), gone.sum(), (train > 0).sum()) if words else 0
        own = [place[i:j] for i, j in zip(at[:-1], at[1:])]
        return pa.Table.from_arrays(
            [
                group.column("block"),
                group.column("kind"),
                group.column("part"),
                pa.array([thin(train[p]) for p in own], pa.binary()),
                pa.array([thin(gone[p]) for p in own], pa.binary()),
                *map(pa.array, total),
            ],
            names=["block", "kind", "part", "train", "gone", "tokens", "gone_tokens", "types"],
        )

    return asked.groupBy("kind", "part").applyInArrow(answer, schema)


def token_counts(block: Block, table: pa.Table, less_deleted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of the block: counts of the pair, of its context and of itself."""
    rows = sorted(table.select(["kind", "part", "train", "gone"]).to_pylist(), key=lambda r: (r["kind"], r["part"]))
    count = []
    for kind in (WORDS, PAIRS):
        own = [thick(r["train"]) - (thick(r["gone"]) if less_deleted else 0) for r in rows if r["kind"] == kind]
        count.append(np.concatenate(own))
    return count[PAIRS][block.place[PAIRS]], count[WORDS][block.context_place], count[WORDS][block.place[WORDS]]


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the whole part of the logarithm to base two."""
    return np.minimum(np.ceil(np.log2(context + 1.0)), BUCKETS - 1).astype(np.int64)


def fold_histogram(blocks: DataFrame, answered: DataFrame, tokens: int) -> DataFrame:
    """Deleted tokens counted by bucket and by the rounded logarithms of their pair and word estimates without them."""
    schema = "b int, q2 int, q1 int, n long"

    def rounded(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.rint(np.log2(np.maximum(p, 1e-300)) * FINE), NOTHING).astype(np.int64)

    def count(key, packs, table):
        if not packs.num_rows:
            return pa.Table.from_pylist([], pa.schema([("b", pa.int32()), ("q2", pa.int32()), ("q1", pa.int32()), ("n", pa.int64())]))
        block = Block(packs.column("pack")[0].as_py())
        pair, context, word = token_counts(block, table, True)
        cells = np.stack([bucket(context), rounded(pair / np.maximum(context, 1)), rounded(word / max(tokens, 1))])
        cells, n = np.unique(cells, axis=1, return_counts=True)
        return pa.Table.from_arrays([*(pa.array(c.astype(np.int32)) for c in cells), pa.array(n)], names=["b", "q2", "q1", "n"])

    both = blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(count, schema)
    return both.groupBy("b", "q2", "q1").agg(F.sum("n").alias("n"))


def fit_weights(rows: pa.Table, types: int) -> np.ndarray:
    """Mixture weights (pair, word, uniform) of each bucket by expectation-maximisation; of a bucket without tokens, those of the
    next smaller one."""
    b, q2, q1, n = (np.asarray(rows.column(c), np.float64) for c in ("b", "q2", "q1", "n"))
    p = np.stack([np.where(q == NOTHING, 0, 2.0 ** (q / FINE)) for q in (q2, q1)] + [np.full(len(n), 1 / (types + 1))], axis=1)
    out = np.empty((BUCKETS, 3))
    last = np.array([0.0, 0.9, 0.1])
    for k in range(BUCKETS):
        own = b == k
        if own.any():
            a = np.full(3, 1 / 3)
            for _ in range(EM_ROUNDS):
                share = p[own] * a
                share *= (n[own] / share.sum(axis=1))[:, None]
                a = share.sum(axis=0) / n[own].sum()
            last = np.maximum(a, LEAST_WEIGHT)
            last /= last.sum()
        out[k] = last
    return out


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known`` (tokens that training has), ``train_tokens``,
    ``base_score`` (words alone, with 0.1 added to each count) and ``score`` (the model's), both logarithms to base ten."""
    remainder = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS, F.lit(-1)).cast("long")
    source = docs.select(F.col(doc_id).alias("id"), remainder.alias("r"), F.col(text).alias("t"))
    blocks = stored(packed_blocks(source), "blocks")
    bits = max(2, int(np.ceil(np.log2(max(blocks.count(), 1)))))
    answered = stored(answers(requests(blocks, bits)), "answers")
    total = answered.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "gone_tokens", "types")]).first()
    tokens, types = total["tokens"], total["types"]
    deleted = blocks.where("deleted")
    seen = fold_histogram(deleted, answered.join(deleted.select("block"), "block", "left_semi"), tokens - total["gone_tokens"])
    weights = fit_weights(seen.toArrow(), types)
    added = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *T.StructType.fromDDL(added).fields])

    def score(key, packs, table):
        block = Block(packs.column("pack")[0].as_py())
        pair, context, word = token_counts(block, table, False)
        a = weights[bucket(context)]
        p = a[:, 0] * pair / np.maximum(context, 1) + a[:, 1] * word / max(tokens, 1) + a[:, 2] / (types + 1)
        base = np.log10((word + 0.1) / (tokens + 0.1 * (types + 1)))
        n = len(block.count)
        return pa.Table.from_arrays(
            [
                block.ids,
                pa.array(block.held_out),
                pa.array(block.count),
                pa.array(np.bincount(block.doc, word > 0, n).astype(np.int64)),
                pa.array(np.full(n, tokens)),
                pa.array(np.bincount(block.doc, base, n)),
                pa.array(np.bincount(block.doc, np.log10(p), n)),
            ],
            names=schema.names,
        )

    needed = answered.select("block", "kind", "part", "train", "gone")
    return blocks.select("block", "pack").groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(score, schema)
