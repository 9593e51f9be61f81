"""Windows of symbols that also start earlier, found over a whole corpus without every document meeting every block.

Each window of `width` symbols picks the least of its k-grams as its anchor, so equal windows pick equal anchors at
equal distances. Windows in a row with one anchor make a segment.

1. A row for each segment - anchor hash, content hash, place - is all that is compared at first. A segment that stands
   earlier with the same anchor and content repeats as a whole; what a batch already tells is marked there. Such whole
   repeats are told by the 64-bit hashes of anchor and content, not byte by byte.
2. The first segments of contents whose anchor also has other contents may repeat in part. They are dealt into RANGES
   by the distance of a window to its anchor. All windows of a range hold the same stretch around the anchor, the
   range's core, and its hash says in which block the content meets others.
3. In a block an index of the method at hand (a function `match`) tells which windows of a content stand in one before
   it; contents that are equal, symbol by symbol, are one. Groups with many contents are told apart by longer cores
   first. A group too large for one task goes on with longer cores in a further round, so no task holds more than
   GROUP_BYTES of one group and no link is lost. Cores end as whole windows, of which there is one content.

Marks (start, windows, row, kind) go back to the documents as one long each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, text_blocks

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POS = np.uint64((1 << 28) - 1)
#: Parts into which the distances of a window to its anchor are dealt at first.
RANGES = 4
#: Contents of a group from which on it is told apart by longer cores, inside a task.
FEW = 64
#: Bytes of contents that one index holds, that a task holds of one group, and of text in a vectorised step.
INDEX_BYTES, GROUP_BYTES, STEP_BYTES = 1 << 20, 1 << 24, 1 << 18
_ROW_BITS = 23
REPEATED, PARTLY = 0, 1


@dataclass(frozen=True)
class Alphabet:
    """symbols(bytes, offsets) gives a 64-bit hash for each symbol, the symbols' offsets, and where each
    symbol starts and ends in the bytes. width and gram count symbols."""

    width: int
    gram: int
    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * _MIX1
        h = (h ^ (h >> np.uint64(29))) * _MIX2
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of any stretch of symbols, from prefix sums modulo 2**64."""

    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, symbols: np.ndarray):
        n = len(symbols) + 1
        if len(Rolling._powers[0]) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            size = max(n, STEP_BYTES + 1)
            Rolling._powers = tuple(np.concatenate([[np.uint64(1)], np.full(size - 1, b)]).cumprod(dtype=np.uint64) for b in (_BASE, inverse))
        self.down = Rolling._powers[1]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(symbols * Rolling._powers[0][: n - 1], dtype=np.uint64, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, n: int) -> np.ndarray:
        """Of every stretch of n symbols."""
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def sliding_least(values: np.ndarray, n: int) -> np.ndarray:
    span = 1
    while span * 2 <= n:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return values if span == n else np.minimum(values[: len(values) - (n - span)], values[n - span :])


def segments(alphabet: Alphabet, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """document, first window (in the document), windows, anchor hash, content hash, anchor place (in all symbols) of each segment."""
    width, k = alphabet.width, alphabet.gram
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    if len(symbols) < width:
        return empty
    rolling = Rolling(symbols)
    v = rolling.grams(k)
    key = (v & ~_POS) | (_POS - np.arange(len(v), dtype=np.uint64))  # ties: the last
    chosen = (_POS - (sliding_least(key, width - k + 1) & _POS)).astype(np.int64)
    windows = np.maximum(0, np.diff(offsets) - width + 1)
    doc = np.repeat(np.arange(len(windows)), windows)
    if not len(doc):
        return empty
    before = np.cumsum(windows) - windows
    at = np.arange(len(doc)) - before[doc] + offsets[:-1][doc]
    anchor = chosen[at]
    new = np.ones(len(doc), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(doc)))
    start, doc = at[first], doc[first]
    return doc, start - offsets[:-1][doc], n, v[anchor[first]], rolling(start, start + n - 1 + width), anchor[first]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row (tells rows with one id apart), text. A null id is before all others."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return docs.select(doc_id.alias("doc_id"), F.xxhash64("doc_id", "text").bitwiseAND((1 << _ROW_BITS) - 1).alias("row"), text.alias("text"))


def sealed(docs: DataFrame) -> DataFrame:
    """doc_id, row, z: the text, compressed before it moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = [pack.compress(x.as_buffer() if x.is_valid else b"") for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], ["doc_id", "row", "z"])

    return _keyed(docs).mapInArrow(run, "doc_id long, row long, z binary")


def _opened(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """text_blocks of compressed texts"""
    unpack = zstandard.ZstdDecompressor()
    for i in range(0, len(column), 200):
        texts = pa.array([unpack.decompress(x) for x in column[i : i + 200].to_pylist()], pa.large_binary())
        for first, end, data, offsets in text_blocks(texts, STEP_BYTES):
            yield i + first, i + end, data, offsets


def _place(start: np.ndarray, n: np.ndarray | int, row: np.ndarray) -> np.ndarray:
    """Start (31 bits), windows (8) and row (23) in one long; in the order of the starts."""
    return start.astype(np.int64) << (8 + _ROW_BITS) | np.asarray(n, np.int64) << _ROW_BITS | row.astype(np.int64)


def _unplaced(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> (8 + _ROW_BITS), (place >> _ROW_BITS) & 0xFF, place & ((1 << _ROW_BITS) - 1)


def _stretches(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, n and number of the original of stretches of windows, in parts of at most 255, as a mark holds."""
    parts = (n + 254) // 255
    which = np.repeat(np.arange(len(n)), parts)
    part = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    return start[which] + 255 * part, np.minimum(255, n[which] - 255 * part), which


# -- segments that repeat as a whole, and those that may in part --------------------------------------

_ROWS = "a long, s long, doc_id long, place long, known boolean"


def _rows(alphabet: Alphabet):
    """Rows of a batch; known: the batch holds an earlier one of the same anchor and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, row = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            out = ([], [], [], [])
            for first, _, data, offsets in text_blocks(b.column(2), STEP_BYTES):
                symbols, places, _, _ = alphabet.symbols(data, offsets)
                doc, start, n, a, s, _ = segments(alphabet, symbols, places)
                for held, x in zip(out, (a, s, ids[first + doc], _place(start, n, row[first + doc])), strict=True):
                    held.append(x)
            if out[0]:
                a, s, own, place = (np.concatenate(x) for x in out)
                order = np.lexsort((place, own, s))
                s_, own_, start = s[order], own[order], _unplaced(place[order])[0]
                new = np.append(True, s_[1:] != s_[:-1])[: len(s)]
                first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
                known = np.zeros(len(s), bool)
                known[order] = ~new & ((own_ != own_[first]) | (start != start[first]))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.view(np.int64), s.view(np.int64), own, place, known)], ["a", "s", "doc_id", "place", "known"])

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, mark of segments that repeat and of firsts whose anchor has other contents, from rows in the order of
    known, a, s, doc_id, place. Only the last first is held, so a group may have any size."""
    last = None  # a, s, doc_id, place of the first of the last content, and whether it has been given out
    for b in batches:
        known = b.column(4).to_numpy(zero_copy_only=False).astype(bool)
        a, s, ids, place = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        out_ids, out = [ids[known]], [place[known] << 1 | REPEATED]
        a, s, ids, place = (x[~known] for x in (a, s, ids, place))
        if len(a):
            start = _unplaced(place)[0]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
            if last is not None:
                new[0] = a[0] != last[0] or s[0] != last[1]
            firsts = np.flatnonzero(new)
            group = np.cumsum(new) - 1  # -1: the content that the last batch began
            f_id, f_start = (np.append(x[firsts], 0) for x in (ids, start))
            if last is not None:
                f_id[-1], f_start[-1] = last[2], last[3] >> (8 + _ROW_BITS)
            repeated = ~new & ((ids != f_id[group]) | (start != f_start[group]))
            out_ids.append(ids[repeated])
            out.append(place[repeated] << 1 | REPEATED)
            if len(firsts):
                own = a[firsts]
                same = np.append(last is not None and own[0] == last[0], own[1:] == own[:-1])  # as the content before
                partly = same | np.append(same[1:], False)
                out_ids.append(ids[firsts[partly]])
                out.append(place[firsts[partly]] << 1 | PARTLY)
                if same[0] and not last[4]:
                    out_ids.append(np.array([last[2]]))
                    out.append(np.array([last[3] << 1 | PARTLY]))
                f = firsts[-1]
                last = (a[f], s[f], int(ids[f]), int(place[f]), bool(partly[-1]))
        if any(map(len, out)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_ids, out)], ["doc_id", "mark"])


# -- contents of these segments, by core --------------------------------------------------------------

_BLOCK = "key long, doc_id long, place long, geo int, content binary"
_NAMES = ["key", "doc_id", "place", "geo", "content"]


@dataclass
class Slices:
    """Stretches of symbols whose windows have their anchor at `anchor`, lo to hi symbols behind their start, and
    the row that each belongs to."""

    beg: np.ndarray
    end: np.ndarray
    anchor: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    row: np.ndarray

    def __getitem__(self, which: np.ndarray) -> Slices:
        return Slices(*(x[which] for x in (self.beg, self.end, self.anchor, self.lo, self.hi, self.row)))

    def ranged(self, lo: np.ndarray, hi: np.ndarray, width: int) -> Slices:
        """What they have with distances lo to hi; those without are left out."""
        low, high = np.maximum(lo, self.anchor - (self.end - width)), np.minimum(hi, self.anchor - self.beg)
        return Slices(self.anchor - high, self.anchor - low + width, self.anchor, lo, hi, self.row)[low <= high]

    def halves(self, width: int) -> tuple[Slices, Slices]:
        middle = (self.lo + self.hi) // 2
        return self.ranged(self.lo, middle, width), self.ranged(middle + 1, self.hi, width)

    def cores(self, rolling: Rolling, width: int) -> np.ndarray:
        """Hash of what all windows of the range hold, and of the range."""
        return mix(rolling(self.anchor - self.lo, self.anchor - self.hi + width) + self.lo.astype(np.uint64))

    def geo(self) -> np.ndarray:
        return ((self.anchor - self.beg) << 16 | self.lo << 8 | self.hi).astype(np.int32)


def _first_ranges(alphabet: Alphabet, at: np.ndarray, n: np.ndarray, anchor: np.ndarray) -> Slices:
    distances = alphabet.width - alphabet.gram + 1
    span = -(-distances // RANGES)
    whole = Slices(at, at + n - 1 + alphabet.width, anchor, np.zeros_like(at), np.full_like(at, distances - 1), np.arange(len(at)))
    parts = [whole.ranged(np.full_like(at, lo), np.full_like(at, min(distances - 1, lo + span - 1)), alphabet.width) for lo in range(0, distances, span)]
    return Slices(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("beg", "end", "anchor", "lo", "hi", "row")))


def _contents(alphabet: Alphabet):
    """Rows of a block from documents with their marks: one for each range of the segments that may repeat in part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, row, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(3)
            for first, end, data, offsets in _opened(b.column(2)):
                symbols, places, starts, ends = alphabet.symbols(data, offsets)
                doc, start, n, _, _, anchor = segments(alphabet, symbols, places)
                wanted = np.zeros(len(doc), bool)
                bounds = np.searchsorted(doc, np.arange(end - first + 1))
                for i in range(end - first):
                    marks = lists[first + i].values.to_numpy()
                    lo, hi = bounds[i], bounds[i + 1]
                    wanted[lo:hi] = np.isin(start[lo:hi], _unplaced(marks[(marks & 1) == PARTLY] >> 1)[0])
                w = np.flatnonzero(wanted)
                if len(w):
                    doc = doc[w]
                    s = _first_ranges(alphabet, places[doc] + start[w], n[w], anchor[w])
                    doc, whole = doc[s.row], data.tobytes()
                    place = _place(s.beg - places[doc], s.end - s.beg - alphabet.width + 1, row[first + doc])
                    content = [whole[i:j] for i, j in zip(starts[s.beg].tolist(), ends[s.end - 1].tolist(), strict=True)]
                    key = s.cores(Rolling(symbols), alphabet.width).view(np.int64)
                    yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (key, ids[first + doc], place, s.geo())), pa.array(content, pa.binary())], _NAMES)

    return run


# -- blocks -------------------------------------------------------------------------------------------

Match = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def repeated_windows(match: Match, symbols: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each symbol of the segments: whether its window stands in a segment of its group that is before
    its own. Segments come by group and, in it, in order.

    Halves of each group in turn: the first half is indexed, the second is matched against it; then the
    halves are halved. So every pair of a group meets in one index and a group of n is indexed log n times.
    """
    found = np.zeros(len(symbols), bool)
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
    ranges = [(int(s), int(e)) for s, e in zip(np.append(0, ends[:-1]), ends, strict=True) if e - s > 1]
    while ranges:
        reference, queries, below = [], [], []
        for s, e in ranges:
            m = (s + e) // 2
            reference.append((s, m))
            queries.append((m, e))
            below += [r for r in ((s, m), (m, e)) if r[1] - r[0] > 1]
        r = np.concatenate([np.arange(s, e) for s, e in reference])
        q = np.concatenate([np.arange(s, e) for s, e in queries])
        rs, ro = _gather(symbols, offsets[:-1][r], offsets[1:][r])
        qs, qo = _gather(symbols, offsets[:-1][q], offsets[1:][q])
        label = np.arange(len(ranges))  # halves meet their own other half only
        hit = match(rs, ro, np.repeat(label, [e - s for s, e in reference]), qs, qo, np.repeat(label, [e - s for s, e in queries]))
        where = np.repeat(offsets[q] - qo[:-1], np.diff(qo)) + np.arange(len(qs))
        found[where] |= hit
        ranges = below
    return found


def _gather(symbols: np.ndarray, beg: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = end - beg
    out = np.zeros(len(beg) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return symbols[np.repeat(beg - out[:-1], sizes) + np.arange(out[-1])], out


def _equal(symbols: np.ndarray, s: Slices, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether slices a and b are the same, symbol by symbol."""
    same = (s.end - s.beg)[a] == (s.end - s.beg)[b]
    x, offsets = _gather(symbols, s.beg[a[same]], s.end[a[same]])
    y, _ = _gather(symbols, s.beg[b[same]], s.end[b[same]])
    differ = np.concatenate([[0], np.cumsum(x != y)])
    same[same] = differ[offsets[1:]] == differ[offsets[:-1]]
    return same


class Block:
    """Contents that meet, in the order of their places. found tells which windows also stand earlier."""

    def __init__(self, alphabet: Alphabet, match: Match, rows: pa.Table, few: int = FEW):
        self.alphabet, self.match, self.few = alphabet, match, few
        self.ids, self.place = rows.column("doc_id").to_numpy(), rows.column("place").to_numpy()
        data = rows.column("content").combine_chunks()
        offs = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
        self.raw = np.frombuffer(data.buffers()[2], np.uint8)[offs[0] : offs[-1]]
        self.symbols, places, self.starts, self.ends = alphabet.symbols(self.raw, offs - offs[0])
        geo = rows.column("geo").to_numpy().astype(np.int64)
        self.rows = Slices(places[:-1], places[1:], places[:-1] + (geo >> 16), (geo >> 8) & 0xFF, geo & 0xFF, np.arange(len(geo)))
        self.key = rows.column("key").to_numpy()
        self.rolling = Rolling(self.symbols)
        self.found = np.zeros(len(self.symbols), bool)

    def firsts(self, s: Slices, group: np.ndarray) -> np.ndarray:
        """For each slice the first of its group with the same content; slices come in order."""
        h = mix(self.rolling(s.beg, s.end) + group.astype(np.uint64))
        _, head, number = np.unique(h, return_index=True, return_inverse=True)
        first = head[number]
        later = np.flatnonzero(first != np.arange(len(h)))
        first[later] = np.where(_equal(self.symbols, s, later, first[later]), first[later], later)
        return first

    def copy(self, s: Slices, of: Slices) -> None:
        """s are equal to earlier contents; a row's own place isn't earlier."""
        n = s.end - s.beg - self.alphabet.width + 1
        start = lambda x: _unplaced(self.place[x.row])[0] + x.beg - self.rows.beg[x.row]
        n = np.where((self.ids[s.row] == self.ids[of.row]) & (start(s) == start(of)), 0, n)
        self.found[np.repeat(s.beg, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = True

    def solve(self) -> None:
        width = self.alphabet.width
        s, group = self.rows, np.unique(self.key, return_inverse=True)[1]
        leaves: list[tuple[Slices, np.ndarray]] = []
        base = 0
        while len(s.beg):
            first = self.firsts(s, group)
            later = np.flatnonzero(first != np.arange(len(first)))
            self.copy(s[later], s[first[later]])
            heads = np.flatnonzero(first == np.arange(len(first)))
            s, group = s[heads], group[heads]
            count = np.bincount(group)[group] if len(group) else group
            many = (count > self.few) & (s.hi > s.lo)
            few = np.flatnonzero((count > 1) & ~many)
            leaves.append((s[few], group[few] + base))
            base += int(group.max()) + 1 if len(group) else 0
            more, group = s[many], group[many]
            parts, groups = [], []
            for side, half in enumerate(Slices(more.beg, more.end, more.anchor, more.lo, more.hi, np.arange(len(group))).halves(width)):
                groups.append(mix(half.cores(self.rolling, width) + mix((group[half.row] * 2 + side).astype(np.uint64))))
                half.row = more.row[half.row]
                parts.append(half)
            s = Slices(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("beg", "end", "anchor", "lo", "hi", "row")))
            group = np.unique(np.concatenate(groups), return_inverse=True)[1] if len(s.beg) else np.zeros(0, np.int64)
            alone = np.bincount(group)[group] == 1 if len(group) else np.zeros(0, bool)
            s, group = s[~alone], group[~alone]
            order = np.lexsort((s.beg, s.row))
            s, group = s[order], group[order]
        s, group = Slices(*(np.concatenate([getattr(x[0], f) for x in leaves]) for f in ("beg", "end", "anchor", "lo", "hi", "row"))), np.concatenate([x[1] for x in leaves])
        if len(s.beg):
            order = np.lexsort((s.beg, s.row, group))
            s, group = s[order], group[order]
            symbols, offsets = _gather(self.symbols, s.beg, s.end)
            hit = repeated_windows(self.match, symbols, offsets, group)
            where = np.repeat(s.beg - offsets[:-1], np.diff(offsets)) + np.arange(len(symbols))
            self.found[where[hit]] = True

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """doc_id and mark of each stretch of found windows."""
        start, _, row = _unplaced(self.place)
        n = np.maximum(0, self.rows.end - self.rows.beg - self.alphabet.width + 1)
        step, which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(np.arange(len(n)), n)
        on = np.flatnonzero(self.found[self.rows.beg[which] + step])
        which, step = which[on], step[on]
        head = np.flatnonzero(np.append(True, (step[1:] != step[:-1] + 1) | (which[1:] != which[:-1]))[: len(step)])
        which, at = which[head], start[which[head]] + step[head]
        at, n, back = _stretches(at, np.diff(np.append(head, len(step))))
        return self.ids[which[back]], _place(at, n, row[which[back]]) << 1 | REPEATED

    def only_copies(self) -> np.ndarray:
        """Marks the copies of whole contents and tells which rows are the first of theirs."""
        first = self.firsts(self.rows, np.unique(self.key, return_inverse=True)[1])
        later = np.flatnonzero(first != np.arange(len(first)))
        self.copy(self.rows[later], self.rows[first[later]])
        return np.flatnonzero(first == np.arange(len(first)))

    def longer_cores(self, which: np.ndarray) -> pa.RecordBatch:
        """The rows' halves, as rows for a further round."""
        s = self.rows[which]
        parts = s.halves(self.alphabet.width)
        s = Slices(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("beg", "end", "anchor", "lo", "hi", "row")))
        start0, _, row = _unplaced(self.place[s.row])
        place = _place(start0 + s.beg - self.rows.beg[s.row], s.end - s.beg - self.alphabet.width + 1, row)
        raw = self.raw.tobytes()
        content = [raw[i:j] for i, j in zip(self.starts[s.beg].tolist(), self.ends[s.end - 1].tolist(), strict=True)]
        key = s.cores(self.rolling, self.alphabet.width).view(np.int64)
        columns = [pa.array(x) for x in (key, self.ids[s.row], place, s.geo())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(content, pa.binary())], _NAMES)


def _in_blocks(alphabet: Alphabet, match: Match, index_bytes: int, group_bytes: int, few: int):
    """Marks (doc_id, mark as place; key is null) of what repeats, and rows for a further round, from rows in the order of
    key, doc_id, place."""

    def out(ids: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.array(ids.astype(np.int64)), pa.array(marks.astype(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], _NAMES
        )

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key = t.column("key").to_numpy()
        new = np.append(True, key[1:] != key[:-1])
        t = t.filter(pa.array(~new | ~np.append(new[1:], True)))  # without those that meet nothing
        if t.num_rows:
            b = Block(alphabet, match, t, few)
            b.solve()
            yield out(*b.marks())

    def without_copies(t: pa.Table) -> tuple[Block, np.ndarray, pa.RecordBatch]:
        b = Block(alphabet, match, t, few)
        firsts = b.only_copies()
        return b, firsts, out(*b.marks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, beyond = 0, None  # beyond: the key of a group that goes on in a further round

        def end_of_group(t: pa.Table, n: int) -> Iterator[pa.RecordBatch]:
            """The first n rows are the rest of a group that is too large."""
            b, firsts, found = without_copies(t.slice(0, n).combine_chunks())
            yield found
            yield b.longer_cores(firsts)

        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                held.append(whole.slice(at, 2000))
                size += held[-1].nbytes
                if size < index_bytes:
                    continue
                t = pa.Table.from_batches(held).combine_chunks()
                key = t.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut and beyond == key[0]:
                    n = int(np.searchsorted(key, key[0], side="right"))
                    yield from end_of_group(t, n)
                    t, cut, beyond = t.slice(n).combine_chunks(), cut - n, None
                if cut:
                    yield from solve(t.slice(0, cut).combine_chunks())
                    t = t.slice(cut).combine_chunks()
                if t.nbytes > group_bytes:  # all of one group
                    b, firsts, found = without_copies(t)
                    yield found
                    left = t.take(pa.array(firsts)).combine_chunks()
                    geo = int(b.rows.hi[0] - b.rows.lo[0])
                    if geo and (beyond is not None or left.nbytes * 2 > group_bytes):
                        beyond = int(b.key[0])
                        yield b.longer_cores(firsts)
                        left = left.slice(0, 0)
                    t = left
                held, size = t.to_batches(), t.nbytes
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            if t.num_rows and beyond == int(t.column("key")[0].as_py()):
                n = int(np.searchsorted(t.column("key").to_numpy(), beyond, side="right"))
                yield from end_of_group(t, n)
                t = t.slice(n).combine_chunks()
            if t.num_rows:
                yield from solve(t)

    return run


def marked(docs: DataFrame, alphabet: Alphabet, match: Match, finish: Callable, schema: str, index_bytes: int = INDEX_BYTES, group_bytes: int = GROUP_BYTES, few: int = FEW) -> DataFrame:
    """finish(bytes, symbol starts, symbol ends, covered) gives the columns after doc_id of one document;
    covered tells which symbols a window covers that also starts earlier."""
    key = ["doc_id", F.shiftright("mark", 1).bitwiseAND((1 << _ROW_BITS) - 1).alias("row")]
    lists = lambda df: df.groupBy(*key).agg(F.collect_list("mark").alias("marks"))
    # what is known to repeat may go anywhere
    where = F.when(F.col("known"), F.xxhash64("doc_id", "place")).otherwise(F.col("a"))
    rows = _keyed(docs).mapInArrow(_rows(alphabet), _ROWS).repartition(where).sortWithinPartitions("known", "a", "s", "doc_id", "place")
    first = settle(lists(rows.mapInArrow(_marks, "doc_id long, mark long")))
    texts = sealed(docs)
    partly = first.where(F.exists("marks", lambda m: m.bitwiseAND(1) == PARTLY))
    todo = texts.join(partly, ["doc_id", "row"]).select("doc_id", "row", "z", "marks").mapInArrow(_contents(alphabet), _BLOCK)
    found = None
    while True:
        blocks = todo.repartition("key").sortWithinPartitions("key", "doc_id", "place").mapInArrow(_in_blocks(alphabet, match, index_bytes, group_bytes, few), _BLOCK)
        blocks = settle(blocks)
        marks = blocks.where("key IS NULL").select("doc_id", F.col("place").alias("mark"))
        found = marks if found is None else found.unionAll(marks)
        todo = blocks.where("key IS NOT NULL")
        if todo.isEmpty():
            break
    second = lists(found).select("doc_id", "row", F.col("marks").alias("more"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, out = (b.column(2), b.column(3)), []
            for first, end, data, offsets in _opened(b.column(1)):
                _, places, starts, ends = alphabet.symbols(data, offsets)
                for i in range(first, end):
                    s, e = places[i - first], places[i - first + 1]
                    step = np.zeros(e - s + 1, np.int64)
                    for marks in (x[i].values.to_numpy() for x in lists if x[i].is_valid):
                        start, n, _ = _unplaced(marks[(marks & 1) == REPEATED] >> 1)
                        np.add.at(step, start, 1)
                        np.add.at(step, start + n - 1 + alphabet.width, -1)
                    o = offsets[i - first]
                    out.append(finish(data[o : offsets[i - first + 1]], starts[s:e] - o, ends[s:e] - o, np.cumsum(step)[:-1] > 0))
            ids = b.column(0)
            ids = pa.array([None if x == -(2**63) else x for x in ids.to_pylist()], pa.int64()) if b.num_rows else ids
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[j] for r in out], t) for j, t in enumerate(types)]], names)

    fields = [x.split() for x in schema.split(",")]
    names, types = ["doc_id", *[f[0] for f in fields]], [{"long": pa.int64(), "string": pa.string()}[f[1]] for f in fields]
    joined = texts.join(first, ["doc_id", "row"], "left").join(second, ["doc_id", "row"], "left").select("doc_id", "z", "marks", "more")
    return joined.mapInArrow(run, f"doc_id long, {schema}")
