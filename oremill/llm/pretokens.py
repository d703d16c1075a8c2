"""Vectorised pre-tokenisation for the lower-casing word-end BPE, and the words it leaves to the library.

That tokenizer lower-cases, drops white space and cuts a text to runs of letters, single digits and runs of other
characters.  For words of printable ASCII and Latin-1 letters this is done here on whole byte buffers.  A word (between
ASCII white space) with any other byte, an apostrophe (contractions) or `<` (special strings) is one unit by itself
and goes through the library whole; no rule of the tokenizer reaches across ASCII white space.
"""

from __future__ import annotations

import numpy as np

from .common import LOWER, SPACE_WORD, flatten, lanes_of, masked, mix, same_words, word_bounds, word_hashes

_LETTER, _DIGIT, _OTHER = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x61:0x7B] = _LETTER
_CLASS[0xC3] = _LETTER
_CLASS[[0x27, 0x3C]] = 0
CACHE_BITS = 21


def units(col) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """buffer, starts, ends, slow (to be taken from the raw text), hashes, and the rows' offsets among the units.

    The buffer is lower-cased except inside slow units.
    """
    raw, offsets = flatten(col)
    starts, ends, bounds = word_bounds(raw, offsets, SPACE_WORD)
    n = len(raw)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return raw, none, none, np.zeros(0, bool), np.zeros(0, np.uint64), bounds
    low = LOWER[raw]
    after = np.zeros(n, bool)
    after[1:] = raw[:-1] == 0xC3
    accented = after & (raw >= 0x80) & (raw <= 0xBF) & (raw != 0x97) & (raw != 0xB7)
    low[accented & (raw <= 0x9E)] += 32
    kind = _CLASS[low]
    kind[accented] = _LETTER
    lead = np.flatnonzero(raw == 0xC3)
    broken = lead[(lead + 1 >= n) | ~accented[np.minimum(lead + 1, n - 1)]]
    kind[broken] = 0
    bad = np.flatnonzero((kind == 0) & SPACE_WORD[raw])
    slow_word = np.zeros(len(starts), bool)
    slow_word[np.searchsorted(starts, bad, side="right") - 1] = True
    edge = np.zeros(n, bool)
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    edge &= SPACE_WORD[raw]
    if slow_word.any():
        mark = np.zeros(n + 1, np.int8)
        mark[starts[slow_word]] += 1
        np.subtract.at(mark, ends[slow_word], 1)
        inside = np.cumsum(mark[:-1], dtype=np.int8) > 0
        edge &= ~inside
        low[inside] = raw[inside]
    edge[starts] = True
    begin = np.flatnonzero(edge)
    leads = np.zeros(n, bool)
    leads[starts] = True
    word = np.cumsum(leads[begin]) - 1
    end = np.append(begin[1:], n)
    end = np.minimum(end, ends[word])
    return low, begin, end, slow_word[word], word_hashes(low, begin, end), np.searchsorted(begin, offsets)


def distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first unit of each sequence of bytes, and each unit's index among those: equal hashes are held against the bytes."""
    while True:
        _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        rep, size = first[back], ends - starts
        at = np.flatnonzero((rep != np.arange(len(rep))) & ((size > 7) | (size[rep] > 7)))  # shorter ones have hashes of their own
        bad = at[~same_words(buf, starts[at], ends[at], buf, starts[rep[at]], ends[rep[at]])]
        if not len(bad):
            return first, back
        hashes = hashes.copy()
        hashes[bad] = mix(hashes[bad] + np.uint64(1))


class Cache:
    """A direct-mapped table from units of up to KEY_BYTES bytes, by their very bytes, to `width` numbers: bounded, and looked up for a whole array at once."""

    KEY_BYTES = 15

    def __init__(self, width: int, dtype):
        self.keys = np.zeros((1 << CACHE_BITS, 2), np.uint64)
        self.values = np.zeros((1 << CACHE_BITS, width), dtype)

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot and key of each unit, and whether the table holds it; longer units are never held."""
        lanes, size = lanes_of(buf), ends - starts
        keys = np.empty((len(starts), 2), np.uint64)
        keys[:, 0] = masked(lanes[starts], size)
        rest = np.clip(size - 8, 0, 7)
        keys[:, 1] = masked(lanes[starts + np.minimum(size, 8)], rest) | size.astype(np.uint64) << np.uint64(56)
        slot = (hashes >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        return slot, keys, (self.keys[slot] == keys).all(axis=1) & (size <= self.KEY_BYTES)

    def put(self, slot: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys[slot], self.values[slot] = keys, values
        # of units that share a slot the last stays, in both arrays
