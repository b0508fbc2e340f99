"""Tokens of two tokenizers for one text, brought together by coalescing their byte ranges.

The tokens of A (byte-level BPE, for a space and the text) and of B (sentence pieces, which add that space themselves) cover the same
bytes. All of them are sorted by where they begin; the running maximum of their ends tells where a group ends: at the first token that
begins where all before it have ended, which is where tokens of A and B end together. Within the groups every A token is expanded into links to
the B tokens that it overlaps.

Each task counts its id pairs before they are summed over the corpus. The pairs with the highest counts (``KNOWN`` at most) go to all
tasks, where each text's links are looked up; links of all other pairs are joined with their counts and added to their text.

Strings of special tokens inside texts are plain text. A text that is null or empty, or whose B bytes aren't those of a space and the text
(where B normalises it away), has no tokens: its counts are 0 and its lists empty. A is lossless. Rows of one id and rows without one are texts
of their own, repeated rows count each time. Other columns aren't looked at, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.llm.arrow import lists, slices
from reelmill.llm.bpe import WORD_PATTERN, byte_signs
from reelmill.llm.store import forget, stored

#: Id pairs whose counts every task gets (16 bytes each).
KNOWN = 1 << 19
#: Id pairs counted in a task before they are passed on.
COUNTED = 1 << 21
#: Bytes of text aligned at once; a longer text is aligned alone.
SLICE_BYTES = 1 << 19
#: Ids written into a digest at once.
DIGESTED = 1 << 20
#: Bits of a B id in an id pair.
BITS = 32
#: Counts are told apart by so many steps for each doubling when the known pairs are chosen.
STEPS = 16
SPACE = "▁"


class Tokenizers:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, bpe_json: str, piece_model: bytes):
        signs, model = byte_signs(), json.loads(bpe_json)["model"]
        token = {i: bytes(signs[c] for c in s) for s, i in model["vocab"].items() if all(c in signs for c in s)}
        ids = {b: i for i, b in token.items()}
        # its merges come in the order of its ids, which is the order in which the other library joins
        joined = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(x >= y for x, y in zip(joined, joined[1:])):
            raise ValueError("the ids of the byte-level vocabulary aren't in the order of its merges")
        plain = set(joined) | {ids[bytes([b])] for b in range(256)}
        self.a = tiktoken.Encoding("a", pat_str=WORD_PATTERN, mergeable_ranks={b: i for b, i in ids.items() if i in plain}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_length = np.array([len(token.get(i, b"")) for i in range(max(token) + 1)], np.int64)
        self.b_length = np.array([len(b) for b in self.b_bytes], np.int64)
        # an id as digits, with what follows it in the text of the groups
        self.digits = [f"{i}{end}".encode() for end in (",", "|") for i in range(len(self.a_length))]
        self.digits += [f"{i}{end}".encode() for end in (",", ";", "") for i in range(len(self.b_length))]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and B of each text, none where the two don't cover the same bytes."""
        none = np.zeros(0, np.int64)
        a, b = [none] * len(texts), [none] * len(texts)
        full = [i for i, t in enumerate(texts) if t]
        for i, pieces in zip(full, self.b.encode([texts[i] for i in full], num_threads=1) if full else ()):
            spaced = " " + texts[i]
            if b"".join(map(self.b_bytes.__getitem__, pieces)) == spaced.encode():
                a[i], b[i] = self.a.encode_to_numpy(spaced).astype(np.int64), np.array(pieces, np.int64)
        return a, b


LOADED: dict[int, Tokenizers] = {}


def loaded(files: tuple[str, bytes]) -> Tokenizers:
    """The tokenizers, kept for later tasks of the same worker."""
    if hash(files) not in LOADED:
        LOADED.clear()
        LOADED[hash(files)] = Tokenizers(*files)
    return LOADED[hash(files)]


class Alignment:
    """Groups and links of texts whose tokens lie in a row: ``a`` and ``b`` are ids, ``a_at`` and ``b_at`` where each text's begin and end."""

    def __init__(self, both: Tokenizers, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray):
        self.both, self.a, self.b, self.a_at, self.b_at = both, a, b, a_at, b_at
        a_end, b_end = np.cumsum(both.a_length[a]), np.cumsum(both.b_length[b])
        a_start, b_start = a_end - both.a_length[a], b_end - both.b_length[b]
        start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
        order = np.lexsort((np.arange(len(start)) >= len(a), start))
        reach = np.maximum.accumulate(end[order])
        fresh = np.ones(len(order), bool)
        fresh[1:] = start[order][1:] >= reach[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(fresh) - 1
        self.a_group, self.b_group = group[: len(a)], group[len(a) :]
        first, last = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
        self.links_of = last - first
        self.link_a = np.repeat(np.arange(len(a)), self.links_of)
        self.link_b = np.arange(len(self.link_a)) + np.repeat(first - (np.cumsum(self.links_of) - self.links_of), self.links_of)

    def pairs(self) -> np.ndarray:
        """The id pair of each link."""
        return self.a[self.link_a] << BITS | self.b[self.link_b]

    def sums(self, of_links: np.ndarray) -> np.ndarray:
        """Sums over the links of each text."""
        upto = np.concatenate([[0], np.cumsum(of_links)])
        ends = np.concatenate([[0], np.cumsum(self.links_of)])[self.a_at]
        return np.diff(upto[ends])

    def group_counts(self) -> np.ndarray:
        upto = np.concatenate([[0], self.a_group + 1])[self.a_at]
        return np.diff(upto)

    def group_ends(self) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens of A, and of B, lie before the end of each group."""
        groups = np.arange(self.a_group[-1] + 1 if len(self.a) else 0)
        return np.searchsorted(self.a_group, groups, "right"), np.searchsorted(self.b_group, groups, "right")

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups, written a1,a2|b1;a3|b2,b3, and '' for a text without tokens."""
        n, m = len(self.both.a_length), len(self.both.b_length)
        last_a, last_b = np.ones(len(self.a), bool), np.ones(len(self.b), bool)
        last_a[:-1], last_b[:-1] = np.diff(self.a_group) > 0, np.diff(self.b_group) > 0
        b_code = 2 * n + self.b + m * last_b
        ends = self.b_at[1:][np.diff(self.b_at) > 0] - 1
        b_code[ends] = 2 * n + 2 * m + self.b[ends]
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + np.searchsorted(self.b_group, self.a_group, "left")] = self.a + n * last_a
        code[np.arange(len(self.b)) + np.searchsorted(self.a_group, self.b_group, "right")] = b_code
        out, at = [], self.a_at + self.b_at
        for low, high in zip(at[:-1].tolist(), at[1:].tolist()):
            digest = hashlib.sha256()
            for k in range(low, high, DIGESTED):
                digest.update(b"".join(map(self.both.digits.__getitem__, code[k : min(high, k + DIGESTED)].tolist())))
            out.append(digest.hexdigest() if high > low else "")
        return out


def joined(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)


class Counts:
    """Counts of numbers, merged as they come."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, numbers: np.ndarray) -> None:
        self.parts.append(np.unique(numbers, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > COUNTED and len(self.parts) > 1:
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        numbers, counts = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in self.parts)]) for k in (0, 1))
        order = np.argsort(numbers, kind="stable")
        numbers, counts = numbers[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])[: len(numbers)])
        return numbers[first], np.add.reduceat(counts, first) if len(first) else counts

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.total()
        self.parts, self.size = [], 0
        return out


def shared_files(docs: DataFrame, bpe_path: str, piece_path: str):
    """Both vocabulary files, a few MB whatever the data, read on the driver and broadcast."""
    with open(bpe_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        return docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))


def token_groups(docs: DataFrame, bpe_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row its ``doc_id``, ids ``a`` and ``b``, and ``a_ends``, ``b_ends``: how many tokens lie before the end of each group."""
    shared = shared_files(docs, bpe_path, piece_path)
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("doc_id", source.schema["id"].dataType), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("a", "b", "a_ends", "b_ends")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = loaded(shared.value)
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE_BYTES):
                ids = [joined(x) for x in both.encode(texts.to_pylist())]
                found = Alignment(both, *ids[0], *ids[1])
                at = np.concatenate([[0], np.cumsum(found.group_counts())])
                ends = [e - np.repeat(start[:-1], np.diff(at)) for e, start in zip(found.group_ends(), (found.a_at, found.b_at))]
                columns = [lists(*ids[0]), lists(*ids[1]), *[lists(e, at) for e in ends]]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def no_rows(n: int, kind: pa.DataType) -> pa.Array:
    return pa.nulls(n, kind)


def tokens_and_counts(source: DataFrame, shared) -> DataFrame:
    """One row per text with its tokens and figures (``row`` tells rows apart), and rows with the counts of id ``pair`` s of each task."""
    fields = T.StructType.fromDDL("row long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, pair long, count long")
    schema = T.StructType([source.schema["id"], *fields])

    def counted(counts: Counts, kind: pa.DataType) -> pa.RecordBatch:
        pairs, n = counts.taken()
        empty = [no_rows(len(pairs), k) for k in (kind, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([*empty, pa.array(pairs), pa.array(n, pa.int64())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, counts, row, kind = loaded(shared.value), Counts(), TaskContext.get().partitionId() << 40, None
        for batch in batches:
            kind = batch.schema.field("id").type
            for part, texts in slices(batch, "text", SLICE_BYTES):
                a, b = (joined(x) for x in both.encode(texts.to_pylist()))
                found = Alignment(both, *a, *b)
                counts.add(found.pairs())
                rows = pa.array(np.arange(row, row + len(part)))
                row += len(part)
                figures = [pa.array(found.group_counts()), pa.array(found.sums(np.ones(len(found.link_a), np.int64))), pa.array(found.digests(), pa.string())]
                ids = [lists(x.astype(np.int32), at) for x, at in (a, b)]
                columns = [part.column("id"), rows, *figures, *ids, no_rows(len(part), pa.int64()), no_rows(len(part), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                if counts.size > COUNTED:
                    yield counted(counts, kind)
        if kind is not None:
            yield counted(counts, kind)

    return source.mapInArrow(run, schema)


def most_frequent(totals: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs and their totals: all whose total reaches a bound that at most ``limit`` pairs reach."""
    step = F.floor(F.log2("total") * STEPS).cast("int")
    sizes = {r.step: r["count"] for r in totals.groupBy(step.alias("step")).count().collect()}  # a few hundred rows at most
    least, held = math.inf, 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > limit:
            break
        least = k
    known = totals.where(step >= F.lit(least)).select("pair", "total").toArrow() if least < math.inf else None
    pair, total = (np.asarray(known.column(k)) if known is not None else np.zeros(0, np.int64) for k in (0, 1))
    order = np.argsort(pair)
    return pair[order], total[order]


def link_scores(texts: DataFrame, shared, counts) -> DataFrame:
    """Of each text (``row``) the sums over its links of known pairs, and rows (``row``, ``pair``, ``times``) of all other pairs."""
    schema = T.StructType.fromDDL("row long, n_best long, count_sum long, pair long, times long")

    def ids_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
        held = batch.column(name)
        sizes = np.asarray(held.value_lengths())
        return np.asarray(held.flatten()).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = loaded(shared.value)
        known, total, best = counts.value
        for batch in batches:
            tokens = np.cumsum(np.asarray(batch.column("a").value_lengths()))
            low = 0
            while low < len(batch):
                before = tokens[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(tokens, before + SLICE_BYTES // 2, "right")))
                part = batch.slice(low, high - low)
                low = high
                found = Alignment(both, *ids_of(part, "a"), *ids_of(part, "b"))
                pairs = found.pairs()
                place = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                hit = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
                count = np.where(hit, total[place], 0) if len(known) else np.zeros(len(pairs), np.int64)
                top = hit & (count == best[pairs & (1 << BITS) - 1])
                rows, none = part.column("row"), no_rows(len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([rows, pa.array(found.sums(top.astype(np.int64))), pa.array(found.sums(count)), none, none], names=schema.names)
                rest = np.flatnonzero(~hit)
                owner = np.repeat(np.arange(len(part)), np.diff(found.a_at))[found.link_a[rest]]
                order = np.lexsort((pairs[rest], owner))
                owner, other = owner[order], pairs[rest][order]
                first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])])[: len(owner)])
                times = np.diff(np.append(first, len(owner)))
                none = no_rows(len(first), pa.int64())
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(owner[first])), none, none, pa.array(other[first]), pa.array(times)], names=schema.names)

    return texts.mapInArrow(run, schema)


def align_tokenizers(
    docs: DataFrame, bpe_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text", known_pairs: int = KNOWN
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the numbers of tokens ``n_a``, ``n_b``, of groups and links, ``groups_sha256``, and over the links
    of the text ``n_best`` (whose id pair is the most frequent one of its B id, ties included) and ``count_sum`` (of the counts of their pairs)."""
    spark = docs.sparkSession
    shared = shared_files(docs, bpe_path, piece_path)
    held = stored(tokens_and_counts(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), shared), "tokens")
    texts = held.where("row IS NOT NULL")
    totals = stored(held.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("count").alias("total")), "pair-totals")
    of_b = F.col("pair").bitwiseAND((1 << BITS) - 1).alias("of_b")
    highest = totals.groupBy(of_b).agg(F.max("total").alias("best"))
    rows = highest.collect()  # a row per B id at most
    best = np.zeros(max((r.of_b for r in rows), default=0) + 1, np.int64)
    for r in rows:
        best[r.of_b] = r.best
    known = spark.sparkContext.broadcast((*most_frequent(totals, known_pairs), best))

    scored = stored(link_scores(texts.select("row", "a", "b"), shared, known), "link-scores")
    rest = scored.where("pair IS NOT NULL").select("row", "pair", "times").join(totals, "pair").join(F.broadcast(highest), F.col("of_b") == of_b)
    top = F.when(F.col("total") == F.col("best"), F.col("times")).otherwise(0)
    rest = rest.groupBy("row").agg(F.sum(top).alias("n_best"), F.sum(F.col("times") * F.col("total")).alias("count_sum"))
    parts = scored.where("pair IS NULL").select("row", "n_best", "count_sum").unionByName(rest)
    sums = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    sizes = [F.size(c).cast("long").alias(f"n_{c}") for c in ("a", "b")]
    named = texts.select("row", F.col("id").alias("doc_id"), *sizes, "n_groups", "n_links", "groups_sha256").join(sums, "row")
    out = stored(named.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "aligned")
    for table in (held, totals, scored):
        forget(table)
    return out
