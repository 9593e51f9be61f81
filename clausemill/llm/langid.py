"""Language identification with language-bitmask n-gram filters.

The Bloom filters of all languages lie bit-sliced in one table: a slot holds one bit for each language.
An n-gram reads k slots and their AND names every language that contains it. A document's score for a
language is the number of its n-grams with that bit, less what the filter's own fill would give by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks

GRAM = 4
SLOTS_LOG2 = 20
PROBES = 3
#: Rows that the filters are fitted on, in expectation; which ones is a hash of the id.
MAX_TRAIN = 12_000
#: A language contains an n-gram if this share of its documents does, and at least the other share of
#: the rate of the language that has it most.
MIN_RATE, MIN_RELATIVE = 0.002, 0.3
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
for _c in range(26):
    _FOLD[0x41 + _c] = _FOLD[0x61 + _c] = 0x61 + _c
_NOTHING = np.uint32(0x20202020)


@dataclass(frozen=True)
class Filters:
    """languages: sorted; table: one row of slots for each 64 languages; fills: share of set slots."""

    languages: list[str]
    prior: int
    table: np.ndarray
    fills: np.ndarray


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of bytes of the folded documents, each with blanks around it, and the documents' offsets in
    them. Everything but letters folds to a blank; n-grams of blanks alone are 0x20202020."""
    n = len(offsets) - 1
    pad = GRAM - 1
    text = np.full(len(data) + pad * (n + 1), 0x20, np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(1, n + 1) * pad, np.diff(offsets))
    text[place] = _FOLD[data]
    wide = text.astype(np.uint32)
    g = wide[:-3] | (wide[1:-2] << np.uint32(8)) | (wide[2:-1] << np.uint32(16)) | (wide[3:] << np.uint32(24))
    # document i: from the blank before its first byte up to its last byte
    starts = offsets + np.arange(1, n + 2) * pad - 1
    keep = np.ones(len(g), bool)
    keep[: starts[0]] = False
    # what begins in the blanks behind a document would reach into the next
    keep[starts[1:-1] - 1] = keep[starts[1:-1] - 2] = False
    g = np.where(keep, g, _NOTHING)
    return g, np.minimum(starts, len(g))


def slots(g: np.ndarray) -> Iterator[np.ndarray]:
    wide = g.astype(np.uint64) + np.uint64(1)
    for m in _MULTIPLIERS[:PROBES]:
        yield (((wide * m) ^ ((wide * m) >> np.uint64(29))) * m) >> np.uint64(64 - SLOTS_LOG2)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        parts: dict[str, list[np.ndarray]] = {}
        for first, end, data, offsets in text_blocks(batch.column(0)):
            g, at = grams(data, offsets)
            for row in range(first, end):
                own = np.unique(g[at[row - first] : at[row - first + 1]])
                parts.setdefault(langs[row], []).append(own[own != _NOTHING])
        for lang, found in parts.items():
            values, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "df"]
            )


def fit(train: DataFrame, max_train: int = MAX_TRAIN) -> Filters:
    """Filters from train(doc_id, text, lang). Rows without text or lang are left out."""
    train = train.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    total = train.count()
    if total > max_train:
        train = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_train / total))
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Filters([], 0, np.zeros((1, 1 << SLOTS_LOG2), np.uint64), np.zeros(0))
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    count = F.create_map(*[F.lit(x) for lang in languages for x in (lang, float(sizes[lang]))])
    df = train.select("text", "lang").mapInArrow(_document_frequencies, "lang string, gram long, df long").groupBy("lang", "gram").agg(F.sum("df").alias("df"))
    rate = df.select("gram", number[F.col("lang")].alias("language"), "df", (F.col("df") / count[F.col("lang")]).alias("rate"))
    most = rate.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("language", "rate", "df")).alias("each"))
    contained = most.select("gram", "most", F.explode("each").alias("x")).where((F.col("x.rate") >= MIN_RATE) & (F.col("x.rate") >= MIN_RELATIVE * F.col("most")) & (F.col("x.df") >= 2))

    def to_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, lang = b.column(0).to_numpy(zero_copy_only=False).astype(np.uint32), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for s in slots(g):
                yield pa.RecordBatch.from_arrays([pa.array(lang // 63), pa.array(s.astype(np.int64)), pa.array(np.int64(1) << (lang % 63))], ["word", "slot", "bits"])

    words = (len(languages) + 62) // 63
    rows = contained.select("gram", F.col("x.language").cast("long").alias("language")).mapInArrow(to_slots, "word long, slot long, bits long").groupBy("word", "slot").agg(F.bit_or("bits").alias("bits"))
    found = rows.toPandas()  # at most 2**SLOTS_LOG2 rows for each 63 languages
    table = np.zeros((words, 1 << SLOTS_LOG2), np.uint64)
    table[found["word"].to_numpy(int), found["slot"].to_numpy(int)] = found["bits"].to_numpy(np.int64).astype(np.uint64)
    fills = np.array([float(np.mean((table[i // 63] >> np.uint64(i % 63)) & np.uint64(1))) for i in range(len(languages))])
    if len(languages) <= 8:
        table = table.astype(np.uint8)
    return Filters(languages, max(range(len(languages)), key=lambda i: sizes[languages[i]]), table, fills)


def scores(filters: Filters, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corrected n-gram counts (documents x languages) and all n-grams of each document."""
    g, at = grams(data, offsets)
    real = g != _NOTHING
    total = np.concatenate([[0], np.cumsum(real)])
    n = (total[at[1:]] - total[at[:-1]]).astype(np.float64)
    hit = [np.where(real, row[place[0]] & row[place[1]] & row[place[2]], 0) for place in [list(slots(g))] for row in filters.table]
    out = np.zeros((len(offsets) - 1, len(filters.languages)))
    for i in range(len(filters.languages)):
        word = hit[i // 63]
        ones = np.concatenate([[0], np.cumsum((word >> word.dtype.type(i % 63)) & word.dtype.type(1), dtype=np.int64)])
        chance = filters.fills[i] ** PROBES
        out[:, i] = np.maximum(0, (ones[at[1:]] - ones[at[:-1]]) - n * chance) / (1 - chance)
    return out, n


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs(doc_id, text).

    lang_pred is 'und' with score 0 if text is null or has no letter, or nothing was learnt. The score is
    the share of the text's n-grams that the language contains. Ties go to the first language by name; a
    text of which no n-gram is known gets the most frequent language with score 0.
    """
    held = docs.sparkSession.sparkContext.broadcast(filters)  # 1 MB for up to 8 languages, 8 MB for up to 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        names = np.array([*f.languages, "und"], object)
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            pred, score = np.full(len(letters), len(f.languages)), np.zeros(len(letters))
            for first, end, data, offsets in text_blocks(batch.column(1)):
                if f.languages:
                    count, n = scores(f, data, offsets)
                    best = count.argmax(1)
                    top = count[np.arange(len(best)), best]
                    pred[first:end] = np.where(top > 0, best, f.prior)
                    score[first:end] = np.minimum(1, top / np.maximum(n, 1))
            pred = np.where(letters, pred, len(f.languages))
            score = np.where(letters, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[pred], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), letters.alias("letters")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, filters: Filters, least: float) -> DataFrame:
    """docs(doc_id, text, ...) without the rows whose language can't be told: those that predict() calls 'und'
    or scores below `least`. Rows are filtered where they are."""
    held = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        for batch in batches:
            keep = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            for first, end, data, offsets in text_blocks(batch.column(text_at)):
                if f.languages:
                    count, n = scores(f, data, offsets)
                    keep[first:end] &= count.max(1) >= least * np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1])).filter(pa.array(keep))

    text_at = docs.columns.index("text")
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("*", letters.alias("__letters")).mapInArrow(run, docs.schema)
