"""Phrases of many texts as arrays: words and pairs of neighbouring words, told by numbers that sort as their strings do."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from reelmill.schemas import PHRASE_MAX_CHARS, PHRASE_MIN_CHARS

#: Bytes of text worked on at once; a longer text is a slice of its own. Each text counts as ``TEXT_COST`` bytes more.
SLICE_BYTES = 4 << 20
TEXT_COST = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def joined_texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of strings, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows of ``batch`` whose texts have at most ``SLICE_BYTES`` together, with those texts."""
    texts = joined_texts(batch.column(column))
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + TEXT_COST)
    low = 0
    while low < len(texts):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(low, high - low), texts.slice(low, high - low)
        low = high


class Words:
    """Tokens of texts that have them joined by blanks: ``word`` is a place in the sorted ``vocabulary``, ``text`` the text's place."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.texts = len(texts)
        self.vocabulary = coded.dictionary.take(pa.array(order))
        self.word = rank[coded.indices.to_numpy()]
        self.text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
        if len(order) and self.vocabulary[0].as_py() == "":  # the empty text has one empty token
            self.keep(self.word > 0)

    def keep(self, wanted: np.ndarray) -> Words:
        self.word, self.text = self.word[wanted], self.text[wanted]
        return self


class Phrases:
    """The distinct words and neighbouring pairs of 2 to 40 characters of each text.

    Row i says that text ``text[i]`` has the phrase ``phrase[i]`` ``n[i]`` times; ``total`` counts the phrases of each text. Phrase p is word
    ``first[p]`` and, unless it is -1, word ``second[p]``; phrases are numbered in the order of their strings, for a blank sorts before all
    that a word can have.
    """

    def __init__(self, words: Words):
        word, text, size = words.word, words.text, len(words.vocabulary) + 1
        chars = pc.utf8_length(words.vocabulary).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(text[1:] == text[:-1])
        left, right = word[at], word[at + 1]
        key = np.concatenate([word * size, left * size + right + 1])
        owner = np.concatenate([text, text[at]])
        length = np.concatenate([chars[word], chars[left] + 1 + chars[right]])
        fits = (length >= PHRASE_MIN_CHARS) & (length <= PHRASE_MAX_CHARS)
        key, owner = key[fits], owner[fits]
        self.vocabulary = words.vocabulary
        self.total = np.bincount(owner, minlength=words.texts)
        keys, place = np.unique(key, return_inverse=True)
        self.first, self.second = np.divmod(keys, size)
        self.second -= 1
        row, self.n = np.unique(owner * max(len(keys), 1) + place, return_counts=True)
        self.text, self.phrase = np.divmod(row, max(len(keys), 1))

    def hashed(self) -> tuple[np.ndarray, np.ndarray]:
        """64 and 16 bits of hash of each phrase; the same phrase has the same ones in any batch."""
        raw = b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in self.vocabulary.cast(pa.binary()).to_pylist()])
        a, b = np.frombuffer(raw, "<u8").reshape(-1, 2).T
        one, two, pair = self.first, self.second, self.second >= 0
        wide = np.where(pair, a[one] * _ODD + b[two], a[one])
        narrow = np.where(pair, b[one] * _ODD + a[two], b[one]) >> np.uint64(48)
        return wide, narrow.astype(np.uint16)

    def strings(self, phrases: np.ndarray) -> pa.Array:
        first = self.vocabulary.take(pa.array(self.first[phrases]))
        second = self.second[phrases]
        pair = self.vocabulary.take(pa.array(second, mask=second < 0))
        return pc.binary_join_element_wise(first, pair, " ", null_handling="skip")


def best_rows(group: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows with the ``top`` highest scores of each group, and their places from 1 on; rows of a group lie together in the order of ties."""
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    ends = np.append(starts[1:], len(group))
    wanted = np.ones(len(group), bool)
    for low, high in zip(starts.tolist(), ends.tolist()):
        if high - low > 2 * top:  # few are left to be sorted
            own = score[low:high]
            least = np.partition(own, high - low - top)[high - low - top]
            above = own > least
            tied = np.flatnonzero(own == least)[: top - int(above.sum())]
            above[tied] = True
            wanted[low:high] = above
    rows = np.flatnonzero(wanted)
    rows = rows[np.lexsort((-score[rows], group[rows]))]
    ranked = group[rows]
    opens = np.flatnonzero(np.diff(ranked, prepend=-1))
    place = np.arange(len(rows)) - np.repeat(opens, np.diff(opens, append=len(rows))) + 1
    best = place <= top
    return rows[best], place[best]


def planes(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte, all lowest bytes first: bytes that are zero in all of them are nothing once compressed."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def sum_by_key(wide: np.ndarray, narrow: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each row the sum of ``counts`` over the rows with its hashes."""
    order = np.argsort(wide)
    opens = np.diff(wide[order]) != 0
    other = narrow[order][1:] != narrow[order][:-1]
    if (other & ~opens).any():  # phrases that only the narrow hash tells apart may lie mixed
        order = np.lexsort((narrow, wide))
        opens = np.diff(wide[order]) != 0
        other = narrow[order][1:] != narrow[order][:-1]
    starts = np.flatnonzero(np.concatenate([[True], opens | other]))
    total = np.add.reduceat(counts[order], starts)
    out = np.empty_like(counts)
    out[order] = np.repeat(total, np.diff(starts, append=len(order)))
    return out
