"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Shards of the labelled sample train on their own, each in its own task, and their weights are averaged
coordinate by coordinate. A score is the logistic of a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, text_blocks

DIMENSIONS_LOG2 = 18
#: Labelled rows that the model is fitted on, in expectation; which ones is a hash of the id.
MAX_TRAIN = 16_000
SHARDS = 16
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_PAIR = np.uint64(0x165667B19E3779F9)
#: Of each byte: 0 blank, 1 word (letters, digits, bytes of other alphabets), 2 anything else.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            have = tuple(np.concatenate([[np.uint64(1)], np.full(size - 1, b)]).cumprod(dtype=np.uint64) for b in (_BASE, inverse))
        if size <= 4 * BLOCK_BYTES:
            _POWERS[0] = have
    return have


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each token (a run of word bytes, or of other bytes that aren't blank) and the
    documents' offsets in them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    border = np.append(np.flatnonzero(new), len(data))
    starts, ends = border[:-1], border[1:]
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
        h = (sums[ends] - sums[starts]) * down[starts]
        h = (h ^ (h >> np.uint64(31))) * _MIX
        h ^= h >> np.uint64(29)
    return h, np.searchsorted(starts, offsets)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and values of each document: one- and two-word n-grams, log counts, unit length. Index 0 is
    the bias."""
    h, at = token_hashes(data, offsets)
    shift = np.uint64(64 - DIMENSIONS_LOG2)
    with np.errstate(over="ignore"):
        one = (h * _MIX) >> shift
        two = ((h[:-1] * _PAIR + h[1:]) * _MIX) >> shift
    for s, e in zip(at[:-1], at[1:], strict=True):
        if e == s:
            yield np.zeros(1, np.int64), np.ones(1)
            continue
        index, count = np.unique(np.concatenate([one[s:e], two[s : e - 1]]).astype(np.int64), return_counts=True)
        value = np.log1p(count)
        value /= np.sqrt(value @ value)
        yield np.append(index, 0), np.append(value, 1.0)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after `epochs` passes over the rows in their order."""
    z, n = np.zeros(1 << DIMENSIONS_LOG2), np.zeros(1 << DIMENSIONS_LOG2)
    for _ in range(epochs):
        for (index, value), y in zip(rows, labels, strict=True):
            zi, ni = z[index], n[index]
            w = _weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - y) * value
            # index 0 may come twice, as the bias and as a hashed n-gram: the last write stands
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[index], n[index] = zi + g - sigma * w, ni + g * g
    return _weights(z, n)


def fit(train: DataFrame, rows: int) -> np.ndarray:
    """Weights from train(doc_id, text, label), of about `rows` rows; label 0 or 1. Without rows all are 0.
    A shard has a thousand rows or more where there are as many."""
    shards = max(1, min(SHARDS, rows // 1000))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "text", "label"])
        text = pa.array(pdf["text"], pa.string())
        rows = [x for _, _, data, offsets in text_blocks(text) for x in features(data, offsets)]
        w = ftrl(rows, pdf["label"].to_numpy(float))
        index = np.flatnonzero(w)
        return pd.DataFrame({"index": index, "weight": w[index]})

    order = F.xxhash64(F.lit(1), F.col("doc_id"))
    cut = train.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), order.alias("order"), F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("double").alias("label"))
    parts = cut.groupBy("shard").applyInPandas(shard, "index long, weight double")
    # rounded, so that the order of the sum does not show
    found = parts.groupBy("index").agg(F.round(F.sum(F.round("weight", 9)) / shards, 9).alias("weight")).toPandas()  # at most 2**DIMENSIONS_LOG2 rows
    w = np.zeros(1 << DIMENSIONS_LOG2, np.float32)
    w[found["index"].to_numpy(int)] = found["weight"].to_numpy()
    return w


def labelled(docs: DataFrame, labels: DataFrame, keep, max_train: int = MAX_TRAIN) -> tuple[DataFrame, int]:
    """doc_id, text, label of a bounded sample of the labelled rows for which keep(doc_id column) holds, and its size.
    Null labels are left out; a document with several labels comes with each."""
    chosen = labels.select("doc_id", F.col("quality").alias("label")).where(keep(F.col("doc_id")) & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    total = chosen.count()
    if total > max_train:
        chosen = chosen.where(F.pmod(F.xxhash64(F.lit(2), F.col("doc_id")), F.lit(1_000_000)) < int(1_000_000 * max_train / total))
    # about max_train pairs of numbers, whatever the input: some hundred kB
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), min(total, max_train)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score for each row of docs(doc_id, text); null and empty texts get the bias's score."""
    held = docs.sparkSession.sparkContext.broadcast(weights)  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            dots = [float(w[i] @ v) for _, _, data, offsets in text_blocks(batch.column(1)) for i, v in features(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(dots, float), -35, 35))))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
