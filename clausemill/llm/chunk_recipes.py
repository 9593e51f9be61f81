"""Exact dedup by content-defined chunk recipes.

Every text is cut where a rolling hash of the last 32 bytes meets a mask, so equal stretches give equal
chunks wherever they stand. A chunk's bytes travel once, to the store that proves its identifier; from
then on a document is its recipe, the ordered list of chunk identifiers, and only recipes are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, settle, text_blocks

WINDOW = 32
MEAN_CHUNK_BITS = 10
MAX_CHUNK = 1 << 16
_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of the six blanks becomes one space, document by document."""
    blank = _SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[starts] = True
    out = np.where(blank, np.uint8(0x20), data)[keep]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return out, before[offsets]


def cuts(data: np.ndarray, offsets: np.ndarray, bits: int = MEAN_CHUNK_BITS) -> list[np.ndarray]:
    """Chunk borders of each document, first and last included; an empty document has none."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8, 16):
        g = h.copy()
        g[s:] += h[:-s] << np.uint32(s)
        h = g
    hit = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    lo, hi = np.searchsorted(hit, offsets[:-1] + WINDOW), np.searchsorted(hit, offsets[1:])
    out = []
    for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        border = [s, *hit[lo[i] : max(lo[i], hi[i])].tolist(), e] if e > s else []
        if any(b - a > MAX_CHUNK for a, b in zip(border, border[1:], strict=False)):
            border = [x for a, b in zip(border, border[1:], strict=False) for x in range(a, b, MAX_CHUNK)] + [e]
        out.append(border)
    return out


def _chunks(column: pa.Array) -> Iterator[tuple[int, bytes, list[tuple[int, int]]]]:
    """(row, normalised bytes, chunk ranges in them)"""
    for first, end, data, offsets in text_blocks(column):
        data, offsets = normalise(data, offsets)
        whole = data.tobytes()
        for row, border in zip(range(first, end), cuts(data, offsets), strict=True):
            s, e = int(offsets[row - first]), int(offsets[row - first + 1])
            yield row, whole[s:e], [(a - s, b - s) for a, b in zip(border, border[1:], strict=False)]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[bytes, bytes] = {}
        size = 0

        def rows(found: dict[bytes, bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[:16] for k in found], pa.binary()), pa.array(found.values(), pa.binary())], ["id", "chunk"])

        for _, text, parts in _chunks(batch.column(0)):
            for a, b in parts:
                chunk = text[a:b]
                k = xxhash.xxh3_128_digest(chunk)
                have = found.get(k)
                if have is None:
                    found[k] = chunk
                    size += b - a
                elif have != chunk:
                    found[k + chunk] = chunk  # two contents with one identifier: both go to the store
            if size > 8 << 20:
                yield rows(found)
                found, size = {}, 0
        if found:
            yield rows(found)


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        recipe, sha = [], []
        for _, text, parts in _chunks(batch.column(2)):
            recipe.append(b"".join(xxhash.xxh3_128_digest(text[a:b]) for a, b in parts))
            sha.append(hashlib.sha256(text).hexdigest())
        columns = [batch.column(0), batch.column(1), pa.array(recipe, pa.binary()), pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "raw", "recipe", "text_sha256"])


def clashing_identifiers(docs: DataFrame) -> DataFrame:
    """Identifiers that stand for two different chunks. Equal chunks are merged before they move."""
    store = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_store, "id binary, chunk binary").distinct()
    return store.groupBy("id").count().where("count > 1").select("id")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after each run of blanks became one space; null counts as
    empty. Of equal texts the smallest id stays; rows with a null id stay only if no other has an id.
    Rows that repeat an id and a text count as copies of which one stays. An empty table gives no rows.
    Only the two named columns are read, so others may have any names.
    """
    return _judged(docs, id_col, text_col).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """exact_duplicates with raw, a hash of the text as it is."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("raw"), "text")
    recipes = settle(
        rows.mapInArrow(_recipes, f"doc_id {kind}, raw long, recipe binary, text_sha256 string").withColumn("uid", F.monotonically_increasing_id())
    )
    # An identifier is good if all chunks that bear it are the same; were one not, the digest of the
    # whole text would tell those documents apart.
    key = ["recipe"] if clashing_identifiers(docs).isEmpty() else ["recipe", "text_sha256"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("uid")))
    groups = settle(recipes.groupBy(*key).agg(first.alias("first"), F.count("*").alias("group_size")).where("group_size > 1"))
    # Both sides are plain tables: a recipe with a large share of the rows is split by the adaptive join.
    return recipes.join(groups, key, "left").select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("first").isNull() | (F.col("first.uid") == F.col("uid"))).alias("kept"),
        "text_sha256",
        "raw",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_duplicates drops, columns unchanged. Of rows that repeat an id and a
    text, null ids included, one stays. Texts don't move: what goes is told by the id and a hash of the text, and only
    rows that repeat both meet each other."""
    of_key = _judged(docs, "doc_id", "text").groupBy("doc_id", "raw").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    touched = beside(of_key.where("NOT kept OR n > 1").select(F.col("doc_id").alias("__of"), F.col("raw").alias("__raw_of"), F.col("kept").alias("__kept")))
    mine = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__doc"), F.xxhash64(F.col("text").cast("string")).alias("__raw"))
    same = F.col("__doc").eqNullSafe(F.col("__of")) & (F.col("__raw") == F.col("__raw_of"))
    alone = mine.join(touched, same, "left_anti").select("__row.*")
    # rows that repeat an id and a text that stays: one of each such key
    again = mine.join(touched.where("__kept"), same, "left_semi")
    nth = F.row_number().over(Window.partitionBy("__doc", "__raw").orderBy("__raw"))
    return alone.unionAll(again.withColumn("__n", nth).where("__n = 1").select("__row.*"))
