"""Substring dedup by relative Lempel-Ziv parsing.

Documents are factored greedily against indexed reference blocks. Content decides which block a stretch
belongs to (see repeats), so no document has to meet every block and still none misses one that holds the
same words. A block is indexed by the order of its suffixes, in which the longest factor at a word is found by
binary search. Where a factor ends, the windows across its boundary are looked up before the parse goes on behind
it, so a repeat that changes its source isn't lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .repeats import FEW, GROUP_BYTES, INDEX_BYTES, Alphabet, Rolling, marked, mix
from .run_index import suffix_array

WINDOW = 20
ANCHOR = 6
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words by their bytes. Up to eight bytes it is one-to-one for each length, beyond it isn't linear in the
    letters, so no words are made to collide by how they are built."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    low = eight[starts] & _HEAD[np.minimum(size, 8)]
    out = mix(low ^ mix(size.astype(np.uint64) + np.uint64(0x5D)))
    wide = np.flatnonzero(size > 8)
    out[wide] = mix(out[wide] ^ mix(eight[ends[wide] - 8] + np.uint64(0xA7)))
    wide = np.flatnonzero(size > 16)
    whole = data.tobytes() if len(wide) else b""
    out[wide] = np.fromiter((xxhash.xxh3_64_intdigest(whole[i:j]) for i, j in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True)), np.uint64, len(wide))
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, offsets, starts and ends of the words of each document."""
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.append(False, solid), np.append(solid, False)
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return word_hashes(data, starts, ends), np.searchsorted(starts, offsets), starts, ends


class ReferenceBlock:
    """A block's segments by group with the order of all their suffixes, so that the longest factor at a word is found
    by binary search."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, group: np.ndarray):
        self.words = np.unique(symbols)
        self.rolling, self.n = Rolling(symbols), len(symbols)
        text = np.zeros(len(symbols) + len(group), np.int64)
        sizes = np.diff(offsets)
        text[np.arange(len(symbols)) + np.repeat(np.arange(len(group)), sizes)] = self._letters(symbols, np.repeat(group, sizes))
        ends = offsets[1:] + np.arange(len(group))
        self.letters = text[np.setdiff1d(np.arange(len(text)), ends, assume_unique=True)]
        order = suffix_array(text, ends)[len(group) :]  # without the ends themselves
        self.order = order - np.searchsorted(ends, order)  # places in symbols
        self.end = np.repeat(offsets[1:], sizes)

    def _letters(self, symbols: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Numbers in the order of group and word; an unknown word falls between its neighbours."""
        at = np.searchsorted(self.words, symbols)
        known = self.words[np.minimum(at, len(self.words) - 1)] == symbols if len(self.words) else np.zeros(len(symbols), bool)
        return (group.astype(np.int64) * (len(self.words) + 1) + at) * 2 + known + 1

    def longest(self, rolling: Rolling, letters: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest factor at each place `at` of a text with these letters, up to most."""

        def common(m: np.ndarray) -> np.ndarray:
            p = self.order[m]
            low, high = np.zeros(len(at), np.int64), np.minimum(most, self.end[p] - p)
            high[letters[at] != self.letters[p]] = 0  # another group or word
            while True:
                todo = np.flatnonzero(low < high)
                if not len(todo):
                    return low
                middle = (low[todo] + high[todo] + 1) // 2
                same = rolling(at[todo], at[todo] + middle) == self.rolling(p[todo], p[todo] + middle)
                low[todo[same]] = middle[same]
                high[todo[~same]] = middle[~same] - 1

        # the first suffix that isn't below the text: it or the one before has most in common
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.n)
        while (low < high).any():
            middle = np.minimum((low + high) // 2, self.n - 1)
            n, p = common(middle), self.order[middle]
            ended = n >= self.end[p] - p  # the suffix is a head of the text, so below it
            i, j = np.minimum(at + n, len(letters) - 1), np.minimum(p + n, self.n - 1)
            below = (n < most) & (ended | (self.letters[j] < letters[i]))
            open_ = low < high
            low = np.where(open_ & below, middle + 1, low)
            high = np.where(open_ & ~below, middle, high)
        return np.maximum(common(np.minimum(low, self.n - 1)), common(np.maximum(low - 1, 0)))

    def factors(self, symbols: np.ndarray, offsets: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
        """Which windows lie in a factor of at least a window's length. All segments are parsed side by side."""
        hit = np.zeros(len(symbols), bool)
        if not self.n or not len(symbols):
            return hit
        rolling, letters = Rolling(symbols), self._letters(symbols, np.repeat(group, np.diff(offsets)))
        at, end = offsets[:-1].copy(), offsets[1:]
        live = np.flatnonzero(at + width <= end)
        while len(live):
            p = at[live]
            length = self.longest(rolling, letters, p, end[live] - p)
            n = np.maximum(length - width + 1, 0)  # windows inside the factor
            hit[np.repeat(p, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = True
            # next: the first window across the factor's end, or the next word of a literal
            at[live] += np.maximum(n, 1)
            live = live[at[live] + width <= end[live]]
        return hit


def match(ref, ref_offsets, ref_group, symbols, offsets, group) -> np.ndarray:
    return ReferenceBlock(ref, ref_offsets, ref_group).factors(symbols, offsets, group, WINDOW)


def _finish(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, covered: np.ndarray) -> tuple[int, int, str]:
    text = data.tobytes()
    kept = [text[s:e] for s, e in zip(starts[~covered].tolist(), ends[~covered].tolist(), strict=True)]
    return len(starts), int(covered.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


ALPHABET = Alphabet(WINDOW, ANCHOR, words)


def remove_repeats(docs: DataFrame, index_bytes: int = INDEX_BYTES, group_bytes: int = GROUP_BYTES, few: int = FEW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs(doc_id, text).

    Words covered by a window of 20 words that also starts earlier go. Null and empty texts have no words. A
    null id is before all others. Rows that share an id and a text are one document; of rows that share an id only,
    the earlier start goes first, then the text's hash. An empty table gives no rows. Only doc_id and text are read. Texts
    of any length are whole.

    index_bytes, group_bytes and few bound an index, a group in a task and a group that isn't split; they change no result.
    """
    return marked(docs, ALPHABET, match, _finish, "n_words long, n_removed long, kept_sha256 string", index_bytes, group_bytes, few)
