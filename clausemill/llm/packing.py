"""Best-fit packing of tokenised documents with a swap-based local search.

Pieces shorter than a sequence are dealt into groups of bounded size. Each group starts from best fit by
decreasing length; then its underfull bins trade documents - a move, one for one, two for one or one for two -
whenever that raises the sum of squared fills, so that full bins get fuller and the emptiest run empty.
Bins that are still underfull meet those of other groups in further rounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import settle

SEQUENCE = 1024
GROUP = 2000
ROUNDS = 3
#: Emptiest bins whose pairs are tried, and exchanges for each underfull bin at most.
DONORS, STEPS = 6, 40


def best_fit(lengths: list[int], size: int = SEQUENCE) -> list[list[int]]:
    """Bins of positions in lengths: longest first, each into the bin that it leaves fullest."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: a bin with room r is open
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = size, len(bins)
            bins.append([i])
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], size: int = SEQUENCE) -> list[list[int]]:
    """Trades between underfull bins until none raises the sum of squared fills; empty bins go."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    open_ = [k for k in range(len(bins)) if fill[k] < size]
    left = STEPS * len(open_)
    improved = True
    while improved and left > 0:
        improved = False
        open_ = sorted((k for k in open_ if 0 < fill[k] < size), key=lambda k: (-fill[k], k))
        where: dict[int, set[int]] = {}
        for k in open_:
            for i in bins[k]:
                where.setdefault(lengths[i], set()).add(k)
        there = sum(1 << n for n in where)

        def trade(a: int, give: list[int], b: int, take: list[int]) -> None:
            nonlocal there
            for k, out, into in ((a, give, take), (b, take, give)):
                for i in out:
                    bins[k].remove(i)
                bins[k].extend(into)
                fill[k] = sum(lengths[i] for i in bins[k])
            for i in (*give, *take):
                for k in (a, b):
                    (where.setdefault(lengths[i], set()).add if any(lengths[j] == lengths[i] for j in bins[k]) else where.setdefault(lengths[i], set()).discard)(k)
                there = there | 1 << lengths[i] if where[lengths[i]] else there & ~(1 << lengths[i])

        def one(low: int, high: int, a: int) -> tuple[int, int] | None:
            """(bin, position) of the longest piece with low < length <= high in a bin no fuller than a."""
            m = there & ((1 << (high + 1)) - 1) & ~((1 << (low + 1)) - 1)
            for _ in range(4):
                if not m:
                    return None
                n = m.bit_length() - 1
                for b in where[n]:
                    if b != a and fill[b] <= fill[a]:
                        return b, next(i for i in bins[b] if lengths[i] == n)
                m &= ~(1 << n)
            return None

        for a in open_:
            while 0 < fill[a] < size and left > 0:
                room, best = size - fill[a], None
                for give in [[], *[[x] for x in bins[a]], *[list(p) for p in combinations(bins[a][:24], 2)]]:
                    out = sum(lengths[i] for i in give)
                    if (found := one(out, min(size, out + room), a)) and (best is None or lengths[found[1]] - out > best[0]):
                        best = (lengths[found[1]] - out, give, found[0], [found[1]])
                        if best[0] == room:
                            break
                if best is None or best[0] < room:
                    for b in [k for k in reversed(open_) if k != a and 0 < fill[k] <= fill[a]][:DONORS]:
                        for take in combinations(bins[b][:24], 2):
                            both = lengths[take[0]] + lengths[take[1]]
                            for give in [[], *[[x] for x in bins[a]]]:
                                gain = both - sum(lengths[i] for i in give)
                                if 0 < gain <= room and (best is None or gain > best[0]):
                                    best = (gain, give, b, list(take))
                if best is None:
                    break
                trade(a, best[1], best[2], best[3])
                left -= 1
                improved = True
    return [b for b in bins if b]


def pack(lengths: list[int], given: list[list[int]] | None = None, size: int = SEQUENCE) -> list[list[int]]:
    """Bins of positions in lengths; of the given bins and best fit's, those that are fewer are searched."""
    fresh = best_fit(lengths, size)
    return local_search(fresh if given is None or len(fresh) < len(given) else given, lengths, size)


def _pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["sequence_id", "uid"], ignore_index=True)
    uid, lengths = pdf["uid"].tolist(), pdf["length"].tolist()
    given: dict[int, list[int]] = {}
    for i, s in enumerate(pdf["sequence_id"].tolist()):
        given.setdefault(s, []).append(i)
    out = []
    for b in pack(lengths, list(given.values())):
        b.sort(key=lambda i: uid[i])
        at, fill = 0, sum(lengths[i] for i in b)
        for i in b:
            out.append((uid[i], lengths[i], uid[b[0]], at, fill))
            at += lengths[i]
    return pd.DataFrame(out, columns=["uid", "length", "sequence_id", "offset", "fill"])


@lru_cache(4)
def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of a tokenizers file, whose ids after the bytes are its merges in order."""
    v = bpe.Vocabulary(path)  # not kept beside the encoding
    ranks = {b: i for i, b in enumerate(v.bytes) if i not in v.special.values()}
    return tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens=v.special)


def tokenise(docs: DataFrame, path: str, end_id: int, size: int = SEQUENCE) -> DataFrame:
    """doc_id, n, crc array<long>: tokens with the end id, and the checksum of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path)
        for batch in batches:
            n, crc = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                special = any(s in text for s in e._special_tokens)
                ids = np.array((e.encode(text, allowed_special="all") if special else e.encode_ordinary(text)) + [end_id], "<u4")
                raw, first = ids.tobytes(), (len(ids) - 1) % size + 1
                n.append(len(ids))
                crc.append([zlib.crc32(raw[: 4 * first]), *[zlib.crc32(raw[4 * i : 4 * (i + size)]) for i in range(first, len(ids), size)]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.list_(pa.int64()))], ["doc_id", "n", "crc"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, crc array<long>")


def assign(items: DataFrame, group: int = GROUP) -> DataFrame:
    """uid, length, sequence_id, offset for items(uid, length) that are shorter than a sequence."""
    todo = items.select("uid", "length", F.col("uid").alias("sequence_id"))
    done = []
    for turn in range(ROUNDS):
        groups = max(1, -(-todo.count() // group))  # so that no group grows with the input
        packed = settle(todo.groupBy(F.pmod(F.xxhash64(F.lit(turn), "sequence_id"), F.lit(groups)).alias("g")).applyInPandas(_pack_group, "uid long, length long, sequence_id long, offset long, fill long"))
        if turn == ROUNDS - 1 or groups == 1:
            done.append(packed)
            break
        done.append(packed.where(F.col("fill") == SEQUENCE))
        todo = packed.where(F.col("fill") < SEQUENCE).select("uid", "length", "sequence_id")
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out.select("uid", "length", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece.

    Null and empty texts are the end id alone. A document longer than a sequence is cut into whole
    sequences after a first piece that has the rest. Rows that repeat an id are packed each by itself; an
    empty table gives no rows. Only doc_id and text are read.
    """
    tokens = settle(tokenise(docs, path, end_id).withColumn("uid", F.monotonically_increasing_id()))
    size = F.lit(SEQUENCE).cast("long")
    first = (F.col("n") - 1) % size + 1
    whole = F.col("n") >= size
    placed = assign(tokens.where(first < size).select("uid", first.alias("length")))
    heads = tokens.select("uid", "doc_id", F.col("crc")[0].alias("ids_crc32")).join(placed, "uid")
    heads = heads.select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), "length", "ids_crc32", "sequence_id", "offset")
    each = tokens.where(whole).select("doc_id", first.alias("first"), F.posexplode("crc").alias("piece", "ids_crc32"))
    full = each.where((F.col("piece") > 0) | (F.col("first") == size)).select(
        "doc_id",
        "piece",
        F.when(F.col("piece") == 0, F.lit(0).cast("long")).otherwise(F.col("first") + (F.col("piece") - 1) * size).alias("start"),
        size.alias("length"),
        "ids_crc32",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return heads.unionAll(full)
