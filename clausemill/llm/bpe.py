"""Byte-level BPE as a bounded-lookahead streaming transducer, and its incremental decoder.

Text goes in block by block and tokens come out as soon as no later text can change them:

* A piece of the split pattern is final once LOOKAHEAD_CHARS characters after it are known.
* Inside a piece, a merge can only be undone by one of lower rank to its right, which frees its left part
  for one of higher rank to its left, and so on. The longest such chain in the merge list bounds how far
  from the end of what is known a token can still change: sufficient_lookahead().

So a run of letters without end needs a window of a few hundred bytes, and memory stays constant.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 1 << 15
#: After a piece of the split pattern: the two letters of a contraction and the end of a run.
LOOKAHEAD_CHARS = 3
#: A piece that is still open and longer than this is encoded while it arrives; a longer one isn't remembered.
LONG_PIECE = 512
#: Entries of each of the two generations of known pieces.
CACHE = 300_000


#: The split pattern of byte-level vocabularies, a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(SPLIT)
#: The same for texts of Latin-1 letters without its six numbers that aren't digits, in a faster library.
_LATIN = re.compile(r"""'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
_ODD = "\u00b2\u00b3\u00b9\u00bc\u00bd\u00be"
#: What an open piece of each class goes on with.
_MORE = {"L": regex.compile(r"\p{L}*"), "N": regex.compile(r"\p{N}*"), "S": regex.compile(r"\s*"), "O": regex.compile(r"[^\s\p{L}\p{N}]*")}


def split(text: str) -> list[str]:
    if text.isascii():
        return _LATIN.findall(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _SPLIT.findall(text)
    return (_SPLIT if any(c in text for c in _ODD) else _LATIN).findall(text)


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}


class Vocabulary:
    """A byte-level BPE file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = _byte_names()
        raw = lambda s: bytes(names[c] for c in s)
        ids = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for s, i in ids.items():
            self.bytes[i] = s.encode() if s in self.special else raw(s)
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.single = [0] * 256
        for i, b in enumerate(self.bytes):
            if len(b) == 1:
                self.single[b[0]] = i
        #: left id and right id in one number -> rank and merged id in one number
        self.merge = {ids[a] << 20 | ids[b]: r << 20 | ids[a + b] for r, (a, b) in enumerate(merges)}
        self.lookahead = sufficient_lookahead([(raw(a), raw(b)) for a, b in merges])
        self.same = list(range(len(self.bytes)))  # one object for each id, whatever holds it
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self.find_special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a final piece: what a run emits for it. Those of short pieces are remembered."""
        found = self.known.get(piece)
        if found is None:
            found = self.before.get(piece)
            if found is None:
                run = Run(self)
                data = piece.encode()
                found = tuple(map(self.same.__getitem__, (*run.push(data), *run.finish())))
                if len(data) > LONG_PIECE:
                    return found
            if len(self.known) >= CACHE:
                self.before, self.known = self.known, {}
            self.known[piece] = found
        return found

    def merged(self, data: bytes) -> list[int]:
        """Merges of the whole of data, lowest rank first, from the left."""
        ids = [self.single[b] for b in data]
        if len(ids) > 48:
            return self._merged_long(ids)
        get = self.merge.get
        none = 1 << 60
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best & 0xFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        get, n = self.merge.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or get(ids[i] << 20 | ids[j]) != r:
                continue
            ids[i], ids[j] = r & 0xFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := get(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := get(ids[h] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (s, h))
        return [x for x in ids if x >= 0]


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes before the end of what is known from which on a token may still change.

    Text that is added can first change the token it touches. A merge (a, b) that is undone or made anew
    changes what stands to its left only through a merge of higher rank whose right part begins with a.
    reach[r] is the longest chain of left parts that starts with merge r.
    """
    best: dict[bytes, int] = {}
    longest, reach = 1, 0
    for a, b in reversed(merges):
        own = len(a) + best.get(a, 0)
        for n in range(1, len(b) + 1):
            if best.get(b[:n], 0) < own:
                best[b[:n]] = own
        longest, reach = max(longest, len(a) + len(b)), max(reach, own)
    return longest + reach


class Run:
    """Encodes one piece of any length while it arrives."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.data = vocabulary, b""

    def push(self, data: bytes) -> list[int]:
        out: list[int] = []
        step = 3 * self.v.lookahead
        for at in range(0, len(data), step):
            self.data += data[at : at + step]
            if len(self.data) >= 2 * self.v.lookahead:
                stable, used = len(self.data) - self.v.lookahead, 0
                for i in self.v.merged(self.data):
                    if used + len(self.v.bytes[i]) > stable:
                        break
                    used += len(self.v.bytes[i])
                    out.append(i)
                self.data = self.data[used:]
        return out

    def finish(self) -> list[int]:
        out, self.data = self.v.merged(self.data), b""
        return out


class Encoder:
    """feed() text in blocks of any size and finish(); each returns the ids that have become final."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.tail, self.run, self.kind = vocabulary, "", None, ""

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        text, self.tail = self.tail + text, ""
        if self.run:
            end = _MORE[self.kind].match(text).end()
            if end == len(text):
                hold = 1 if self.kind == "S" else 0
                self.tail = text[len(text) - hold :] if hold else ""
                return self.run.push(text[: len(text) - hold].encode())
            out, text = self._close(text, end)
        pieces = split(text)
        held = 0
        while pieces and held < LOOKAHEAD_CHARS:
            held += len(pieces.pop())
        out.extend(chain.from_iterable(map(self.v.piece, pieces)))
        self.tail = text[len(text) - held :]
        if held > LONG_PIECE:
            self._open(out)
        return out

    def _open(self, out: list[int]) -> None:
        """What is held back ends with a long piece that may go on."""
        *first, last = split(self.tail)
        if len(last) <= LONG_PIECE:
            return
        out.extend(chain.from_iterable(map(self.v.piece, first)))
        self.kind = "S" if last.isspace() else next(k for k in "LNO" if _MORE[k].match(last[-1]).end())
        self.run, self.tail = Run(self.v), last[-1:] if self.kind == "S" else ""
        out.extend(self.run.push(last[: len(last) - len(self.tail)].encode()))

    def _close(self, text: str, end: int) -> tuple[list[int], str]:
        """The open piece ends before text[end]; of blanks, the last one belongs to what follows."""
        last = end - 1 if self.kind == "S" else end
        out = self.run.push(text[:last].encode()) + self.run.finish()
        self.run = None
        return out, text[last:]

    def finish(self) -> list[int]:
        if self.run:
            out = self.run.push(self.tail.encode()) + self.run.finish()
            self.run, self.tail = None, ""
            return out
        out, self.tail = list(chain.from_iterable(map(self.v.piece, split(self.tail)))), ""
        return out


class Decoder:
    """feed() ids and finish(); text comes out as soon as its bytes are complete."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.state = vocabulary, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.state.decode(b"".join(map(self.v.bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def encode(vocabulary: Vocabulary, text: str) -> Iterator[list[int]]:
    """Blocks of ids, each as soon as it is final. Every text goes through feed and finish, whatever its length. The
    strings of added tokens are those tokens, as in the library."""
    at = 0
    cuts = vocabulary.find_special.finditer(text) if vocabulary.find_special else ()
    for m in [*cuts, None]:
        part = text[at : m.start() if m else len(text)] if at or m else text
        if part:
            e = Encoder(vocabulary)
            for i in range(0, len(part), BLOCK_CHARS):
                yield e.feed(part[i : i + BLOCK_CHARS])
            yield e.finish()
        if m:
            yield [vocabulary.special[m.group()]]
            at = m.end()


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """Read once in each Python worker."""
    return Vocabulary(path)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs; null texts count as empty.

    Rows that repeat an id are encoded each by itself, null ids included; an empty table gives no rows. Only doc_id and
    text are read, so others may have any names. Ids and text are hashed block by block, so a text of any length needs no more memory than its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for value in batch.column(1):
                count, ids_hash, text_hash, decoder, comma = 0, hashlib.sha256(), hashlib.sha256(), Decoder(v), ""
                for ids in encode(v, value.as_py() or ""):
                    if ids:
                        count += len(ids)
                        ids_hash.update((comma + ",".join(map(v.decimal.__getitem__, ids))).encode())
                        comma = ","
                        text_hash.update(decoder.feed(ids).encode())
                text_hash.update(decoder.finish().encode())
                n.append(count)
                ids_sha.append(ids_hash.hexdigest())
                text_sha.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int> for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            ids = [array("i", chain.from_iterable(encode(v, x.as_py() or ""))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def texts(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text for each row of tokens(doc_id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            out = []
            for x in batch.column(1):
                d = Decoder(v)
                out.append(d.feed(x.as_py() or []) + d.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
