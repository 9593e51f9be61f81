"""Substring dedup with a run-length index.

Repetitive text has few runs in its Burrows-Wheeler transform. A block's index keeps only these runs, with
the suffix array sampled at their two ends. Other text streams through it from right to left and carries
its matching statistics along: the length and one place of the longest match that starts at each byte.
Matches of at least WIDTH bytes are marked. Which texts meet in a block, and in which order, is settled by
content (see repeats), so no two documents with a long match in common miss each other.

Where a match can't go on, the longer of the two next candidates is told by comparing with the block's text. The
prefix hashes that answer this in constant time are kept beside the runs, 8 bytes for each byte of the block; so the
transform and its suffix samples are run-compressed, the index as a whole is not, and a block is bounded instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .repeats import FEW, GROUP_BYTES, INDEX_BYTES, Alphabet, Rolling, marked, mix

WIDTH = 100
ANCHOR = 24
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BACK = np.argsort(_BYTE)
_SORTED = _BYTE[_BACK]


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(len(data) + 1)
    return _BYTE[data], offsets, at[:-1], at[1:]


def suffix_array(letters: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes of texts that follow each other, a letter 0 after each (at `ends`). Letters
    are below 2**51 and 0 only there; each end counts as a letter of its own, in their order. Ties of the
    first letters are broken by doubling the length that is compared; only ties are sorted again."""
    n = len(letters)
    first = letters.copy()
    first[ends] = np.arange(len(ends)) - len(ends)
    order = np.argsort(first, kind="stable")
    key = first[order]
    rank = np.zeros(n, np.int64)
    slots, h = np.arange(n), 1
    while True:
        new = np.append(True, key[1:] != key[:-1])
        head = slots[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        rank[order[slots]] = head
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        if not len(slots):
            return order
        # a tie doesn't reach its text's end within h letters, so place + h is in the same text
        place = order[slots]
        key = rank[place] * n + rank[place + h]
        by = np.argsort(key, kind="stable")
        order[slots], key = place[by], key[by]
        h *= 2


class RunLengthIndex:
    """Runs of the transform of several texts. Letters must be positive."""

    def __init__(self, letters: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        text = np.zeros(len(letters) + len(sizes), np.int64)
        text[np.arange(len(letters)) + np.repeat(np.arange(len(sizes)), sizes)] = letters
        ends = offsets[1:] + np.arange(len(sizes))
        sa = suffix_array(text, ends)
        bwt = text[sa - 1]  # before the first letter stands the last end
        new = np.append(True, bwt[1:] != bwt[:-1])
        self.start = np.flatnonzero(new)
        self.letter = bwt[self.start]
        size = np.diff(np.append(self.start, len(bwt)))
        self.end = self.start + size - 1
        self.at_start, self.at_end = sa[self.start], sa[self.end]
        # runs by letter: the letters before a run in this order tell where its first letter goes
        self.by_letter = np.argsort(self.letter, kind="stable")
        self.maps_to = np.zeros(len(size), np.int64)
        self.maps_to[self.by_letter] = np.cumsum(size[self.by_letter]) - size[self.by_letter]
        self.letters, number = np.unique(self.letter, return_inverse=True)
        self.keys = number[self.by_letter] * len(size) + self.by_letter
        self.hash = Rolling(text.astype(np.uint64))
        self.n = len(text)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Letters that the suffixes at a and b have in common, up to most."""
        low, high = np.zeros(len(a), np.int64), np.minimum(most, self.n - np.maximum(a, b))
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                return low
            middle = (low[todo] + high[todo] + 1) // 2
            same = self.hash(a[todo], a[todo] + middle) == self.hash(b[todo], b[todo] + middle)
            low[todo[same]] = middle[same]
            high[todo[~same]] = middle[~same] - 1

    def matching_statistics(self, letters: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length and place of the longest match from each letter on, inside its own text. All texts stream
        side by side, each from its last letter to its first."""
        length, place = np.zeros(len(letters), np.int64), np.full(len(letters), -1, np.int64)
        sizes = np.diff(offsets)
        by_size = np.argsort(-sizes, kind="stable")
        last, sizes = offsets[1:][by_size] - 1, sizes[by_size]
        # nothing matched yet: the first row, and the place of its suffix
        row, size, at = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.full(len(sizes), self.at_start[0] if self.n else 0)
        runs = len(self.start)
        number = np.searchsorted(self.letters, letters)
        number[number == len(self.letters)] = 0
        known = self.letters[number] == letters
        for t in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -t, side="left"))
            p = last[:live] - t
            run = np.searchsorted(self.start, row[:live], side="right") - 1
            goes_on = self.letter[run] == letters[p]
            step = row[:live] - self.start[run]
            row[:live] = np.where(goes_on, self.maps_to[run] + step, row[:live])
            size[:live] += goes_on
            at[:live] -= goes_on
            lost = np.flatnonzero(~goes_on)
            gone = lost[~known[p[lost]]]
            size[gone] = 0
            jump = lost[known[p[lost]]]
            if len(jump):
                key = number[p[jump]] * runs + run[jump]
                k = np.searchsorted(self.keys, key)
                up = self.keys[np.maximum(k - 1, 0)]
                down = self.keys[np.minimum(k, runs - 1)]
                mine = number[p[jump]]
                has_up, has_down = (k > 0) & (up // runs == mine), (k < runs) & (down // runs == mine)
                up, down = up % runs, down % runs
                most = size[jump]
                one = np.where(has_up, self.common(at[jump], self.at_end[up], np.where(has_up, most, 0)), -1)
                two = np.where(has_down, self.common(at[jump], self.at_start[down], np.where(has_down, most, 0)), -1)
                above = one >= two
                to = np.where(above, up, down)
                row[jump] = self.maps_to[to] + np.where(above, self.end[to] - self.start[to], 0)
                size[jump] = np.maximum(one, two) + 1
                at[jump] = np.where(above, self.at_end[to], self.at_start[to]) - 1
            length[p], place[p] = size[:live], np.where(size[:live] > 0, at[:live], -1)
        return length, place


def match(ref, ref_offsets, ref_group, symbols, offsets, group) -> np.ndarray:
    """The group is part of a letter, so that texts match those of their own group."""

    def letters(symbols: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> np.ndarray:
        return np.repeat(group.astype(np.int64) << 9, np.diff(offsets)) + _BACK[np.searchsorted(_SORTED, symbols)] + 1

    index = RunLengthIndex(letters(ref, ref_offsets, ref_group), ref_offsets)
    length, _ = index.matching_statistics(letters(symbols, offsets, group), offsets)
    return length >= WIDTH


def _finish(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, covered: np.ndarray) -> tuple[int, int, int, str]:
    spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()) if len(covered) else 0
    return len(data), int(covered.sum()), spans, hashlib.sha256(data[~covered].tobytes()).hexdigest()


ALPHABET = Alphabet(WIDTH, ANCHOR, byte_symbols)


def remove_repeats(docs: DataFrame, index_bytes: int = INDEX_BYTES, group_bytes: int = GROUP_BYTES, few: int = FEW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs(doc_id, text).

    Bytes covered by a string of 100 bytes that also starts earlier go. Null texts count as empty. A null id
    is before all others. Rows that share an id and a text are one document; of rows that share an id only, the earlier start
    goes first, then the text's hash. An empty table gives no rows. Only doc_id and text are read. Texts of any length
    are whole: a text is one step of a task, and matches in it are found like those between documents.

    index_bytes, group_bytes and few bound an index, a group in a task and a group that isn't split; they change no result.
    """
    return marked(docs, ALPHABET, match, _finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", index_bytes, group_bytes, few)
