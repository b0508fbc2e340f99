"""Words of texts as 64-bit hashes, computed over whole byte buffers.

A word is a run of bytes other than the six white ones (space, tab to carriage return); A to Z count as a to z.
"""

from __future__ import annotations

import hashlib

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Longer words are hashed one by one.
LONG_WORD = 256
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * ODD[1]
    x = (x ^ (x >> np.uint64(27))) * ODD[2]
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the texts between ``offsets`` begin and end in ``data``."""
    solid = ~WHITE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n + 1 places where the words of each text begin and end."""
    lower = LOWER[data]
    begin, end = word_spans(lower, offsets)
    size = end - begin
    padded = np.concatenate([lower, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(lower) + 1,), "<u8", padded, strides=(1,))
    h = mix(size.astype(np.uint64) + ODD[0])
    todo, step = np.arange(len(begin)), 0
    while len(todo):
        left = size[todo] - step
        chunk = eight[begin[todo] + step] & KEEP[np.minimum(left, 8)]
        h[todo] = mix(h[todo] * ODD[0] ^ chunk)
        step += 8
        todo = todo[(left > 8) & (size[todo] <= LONG_WORD)]
    for k in np.flatnonzero(size > LONG_WORD):
        h[k] = int.from_bytes(hashlib.blake2b(lower[begin[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return h, np.searchsorted(begin, offsets)


def shingle_hashes(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of ``n`` words of each text, sorted by text and hash, and where each text's begin and end.

    A text of fewer words has one shingle, all its words; a text without words has none.
    """
    count = np.diff(at)
    short = count < n
    h = np.zeros(len(words), np.uint64)
    if len(words) >= n:
        m = len(words) - n + 1
        h[:m] = words[:m]
        for k in range(1, n):
            h[:m] = mix(h[:m] * ODD[0] + words[k : k + m])
    text = np.repeat(np.arange(len(count)), count)
    whole = np.arange(len(words)) + n <= at[1:][text]
    for d in np.flatnonzero(short & (count > 0)):
        x = words[at[d] : at[d] + 1].copy()
        for w in words[at[d] + 1 : at[d + 1]]:
            x = mix(x * ODD[0] + w)
        h[at[d]] = mix(x + np.uint64(count[d]))[0]  # as one sequence, not as the start of a longer one
        whole[at[d]] = True
    h, text = h[whole], text[whole]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(count) + 1))
