"""Byte-pair encoding and decoding by forced boundaries.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never be joined by a merge, so the text is
certainly cut there. Words are cut at all such pairs, the fragments are encoded independently (and remembered, since they
recur), and the ids are put in a row. Decoding gathers the bytes of the ids.

Null texts are empty texts and have no ids. Bytes that aren't UTF-8 after decoding arbitrary ids become U+FFFD.
"""

from __future__ import annotations

import heapq
import json
import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from reelmill.llm.arrow import append_columns, lists

# Fixed value: how the byte-level tokenizer cuts a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of words or fragments and their ids remembered before starting afresh; an entry of over an eighth of them isn't remembered.
REMEMBERED_BYTES = 40 << 20
#: Bytes of an entry besides its key and value.
ENTRY_BYTES = 100
#: Bits of an id in a pair of ids; no pair is joined at rank NEVER.
BITS = 20
NEVER = 1 << 62
#: Fragments up to this length are merged by rescanning, longer ones with a queue.
SHORT = 48


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Remembered(dict):
    """A memory of a function of one argument, bounded in bytes."""

    def __init__(self, function):
        super().__init__()
        self.function, self.left = function, REMEMBERED_BYTES

    def __missing__(self, key):
        value = self.function(key)
        size = ENTRY_BYTES + sys.getsizeof(key) + sys.getsizeof(value)
        if size > REMEMBERED_BYTES >> 3:
            return value
        if size > self.left:
            self.clear()
            self.left = REMEMBERED_BYTES
        self.left -= size
        self[key] = value
        return value


class NotApart(Exception):
    """Raised for a piece whose encoding depends on its neighbours."""


class Vocabulary:
    """A byte-level BPE vocabulary read from the text of its JSON file."""

    def __init__(self, text: str):
        file = json.loads(text)
        signs, model = byte_signs(), file["model"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        token = {i: bytes(signs[c] for c in s) for s, i in model["vocab"].items()}
        of_bytes = {b: i for i, b in token.items()}
        self.joined: dict[int, int] = {}  # pair of ids -> rank and id of the joined token
        for rank, pair in enumerate(model["merges"]):
            a, b = (model["vocab"][x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.joined[a << BITS | b] = rank << BITS | of_bytes[token[a] + token[b]]
        self.byte_id = [of_bytes[bytes([b])] for b in range(256)]
        inside = np.zeros((256, 256), bool)
        for b in token.values():
            inside[[*b[:-1]], [*b[1:]]] = True
        self.inside = [row.tobytes() for row in inside]
        token |= {i: s.encode() for s, i in self.special.items()}
        size = max(token) + 1
        self.length = np.array([len(token.get(i, b"")) for i in range(size)], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(token.get(i, b"") for i in range(size)), np.uint8)
        self.words = regex.compile(WORD_PATTERN)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fragment = Remembered(self.merge)
        self.word = Remembered(self.encode_word)
        self.piece = Remembered(self.encode_piece)

    def encode_piece(self, piece: str) -> bytes:
        """Ids of a space and ``piece``. A space between two signs that aren't white always begins a word."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise NotApart
        words = self.words.findall(" " + piece)
        return self.encode_word(words[0]) if len(words) == 1 else b"".join(map(self.word.__getitem__, words))

    def encode_word(self, word: str) -> bytes:
        """Ids of a word, cut wherever no token reaches across two bytes."""
        raw, inside = word.encode(), self.inside
        at = [i for i in range(1, len(raw)) if not inside[raw[i - 1]][raw[i]]]
        if not at:
            return self.merge(raw)
        return b"".join(self.fragment[raw[i:j]] for i, j in zip([0, *at], [*at, len(raw)]))

    def merge(self, raw: bytes) -> bytes:
        """Ids (32-bit) of a fragment: the pair of lowest rank is joined first, of equal pairs the leftmost."""
        ids = [self.byte_id[b] for b in raw]
        return array("i", self.merge_short(ids) if len(ids) <= SHORT else self.merge_long(ids)).tobytes()

    def merge_short(self, ids: list[int]) -> list[int]:
        get = self.joined.get
        ranks = [get(a << BITS | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            ids[i : i + 2] = [new := best & (1 << BITS) - 1]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << BITS | new, NEVER)
            if i < len(ranks):
                ranks[i] = get(new << BITS | ids[i + 1], NEVER)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """As merge_short, with a queue of pairs in place of the scan for the best one."""
        get, n = self.joined.get, len(ids)
        before, after, gone = list(range(-1, n - 1)), list(range(1, n + 1)), [False] * n
        queue = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (r := get(pair := ids[i] << BITS | ids[after[i]])):
                heapq.heappush(queue, (r, i, pair))

        for i in range(n - 1):
            offer(i)
        while queue:
            best, i, pair = heapq.heappop(queue)
            j = after[i]
            if gone[i] or j >= n or ids[i] << BITS | ids[j] != pair:
                continue
            ids[i], gone[j], after[i] = best & (1 << BITS) - 1, True, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [x for x, dead in zip(ids, gone) if not dead]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), np.int32)

    def encode_bytes(self, text: str) -> bytes:
        if self.cut_special is None or not any(s in text for s in self.special):
            return self.encode_plain(text)
        parts = self.cut_special.split(text)
        return b"".join(array("i", [self.special[p]]).tobytes() if i % 2 else self.encode_plain(p) for i, p in enumerate(parts))

    def encode_plain(self, text: str) -> bytes:
        word = self.word.__getitem__
        first, *pieces = text.split(" ")
        if pieces and first and not first[-1].isspace():
            try:
                return b"".join([*map(word, self.words.findall(first)), *map(self.piece.__getitem__, pieces)])
            except NotApart:
                pass
        return b"".join(map(word, self.words.findall(text)))

    def decode_many(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids in a row, and where each of the lists between ``offsets`` begins and ends in them."""
        length = self.length[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total, dtype=np.int64) + np.repeat(self.start[ids] - (ends - length), length)
        return self.bytes[place], np.concatenate([[0], ends])[offsets]

    def decode(self, ids: list[int]) -> str:
        raw, _ = self.decode_many(np.asarray(ids, np.int64), np.array([0, len(ids)]))
        return raw.tobytes().decode("utf-8", "replace")


LOADED: dict[int, Vocabulary] = {}


def loaded(text: str) -> Vocabulary:
    """The vocabulary, kept for later tasks of the same worker."""
    if hash(text) not in LOADED:
        LOADED.clear()
        LOADED[hash(text)] = Vocabulary(text)
    return LOADED[hash(text)]


def bpe_round_trip(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the token ids of ``text`` and the text decoded from those ids.

    ``vocabulary`` is the path of a byte-level BPE tokenizer file, a few MB whatever the data; it is read on the driver and
    broadcast. Special tokens written in a text get their ids, and none are added. Input columns called as a result are replaced.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        vocab = loaded(shared.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            encoded = [vocab.encode_bytes(t) for t in texts.to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int64)
            flat = np.frombuffer(b"".join(encoded), np.int32)
            raw, at = vocab.decode_many(flat, offsets)
            return [lists(flat, offsets), utf8_array(raw, at)]

        return work

    return append_columns(df, text, f"`{ids}` array<int>, `{decoded}` string", make)


def utf8_array(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Strings from bytes in a row; what isn't UTF-8 is replaced."""
    made = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes()))
    try:
        made.validate(full=True)
    except pa.ArrowInvalid:
        b = raw.tobytes()
        return pa.array([b[i:j].decode("utf-8", "replace") for i, j in zip(offsets[:-1], offsets[1:])], pa.string())
    return made


def encode_texts(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text`` alone."""
    return bpe_round_trip(df, vocabulary, text, ids, "__decoded").drop("__decoded")


def decode_ids(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text of the token ids of ``ids``; null ids are an empty list, null elements are left out."""
    from pyspark.sql import types as T

    with open(vocabulary, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    kept = df.select(*[c for c in df.columns if c.lower() != decoded.lower()])
    schema = T.StructType([*kept.schema.fields, T.StructField(decoded, T.StringType())])

    def run(batches):
        vocab = loaded(shared.value)
        for batch in batches:
            rows = [np.array([x for x in r or [] if x is not None], np.int64) for r in batch.column(ids).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            raw, at = vocab.decode_many(np.concatenate([np.zeros(0, np.int64), *rows]), offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, utf8_array(raw, at)], names=schema.names)

    return kept.mapInArrow(run, schema)


