"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints of two documents link at MAX_BITS differing bits or fewer. The 64 bits are dealt into PARTS
partitions, correlated bits together. A fingerprint probes partition i for values within t_i bits, where
the thresholds sum to MAX_BITS - PARTS + 1 (-1: not probed); any link then shows in a partition it probes.
Each fingerprint gets its own thresholds, by dynamic programming on estimated candidate counts.

A value that very many fingerprints share isn't probed at all. Fingerprints that bear or would probe it
emit themselves and their 64 neighbours at one bit instead; two of them are within two bits exactly if they
meet in such a centre, at which no more than 65 can meet. So no group is large, whatever the copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, text_blocks
from .components import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
PARTS = 3
#: Fingerprints from which the correlation of bits is estimated, in expectation.
SAMPLE = 20_000
#: Buckets of the counts by which candidates are estimated, for each partition.
BUCKETS_LOG2 = 16
#: Fingerprints by bucket from which on a value counts as hot, times the mean and at least.
HOT, HOT_MEAN = 256, 8

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the 64-bit hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(np.ascontiguousarray(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(bits), 255):  # sums of at most 255 fit a byte
        ones += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        out = []
        for _, _, data, offsets in text_blocks(batch.column(1)):
            blank = _BLANK[data]
            first = ~blank
            first[1:] &= blank[:-1]
            heads = offsets[:-1][offsets[:-1] < offsets[1:]]
            first[heads] = ~blank[heads]
            # words joined by one space: a space goes before each word that isn't its document's first
            starts = np.flatnonzero(first)
            lower = _LOWER[data]
            keep = ~blank
            text = np.full(int(keep.sum()) + len(starts), 0x20, np.uint8)
            text[np.arange(int(keep.sum())) + np.cumsum(first)[keep]] = lower[keep]
            whole = text.tobytes()
            at = (np.cumsum(keep)[starts] - 1 + np.arange(1, len(starts) + 1)).tolist() + [len(text) + 1]
            bounds = np.searchsorted(starts, offsets).tolist()
            for a, b in zip(bounds, bounds[1:], strict=False):
                n = max(1, b - a - SHINGLE + 1) if b > a else 0
                k = min(SHINGLE, b - a)
                out.append(fingerprint(np.array([digest(whole[at[i] : at[i + k] - 1], SEED) for i in range(a, a + n)], np.uint64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp long; null texts count as empty, and texts without words have 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


# -- plan ---------------------------------------------------------------------------------------------


def partition_bits(sample: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Bit numbers (0 is the lowest) dealt into parts of nearly equal width. Each part takes, one by one, the
    bit that correlates most with those it has, so that what varies together is compared together."""
    if len(sample) < 2:
        corr = np.zeros((64, 64))
    else:
        bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
        bits -= bits.mean(0)
        norm = np.sqrt((bits * bits).sum(0))
        corr = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
        np.fill_diagonal(corr, 0)
        corr = np.round(corr, 6)
    free, out = list(range(64)), []
    for p in range(parts):
        width = len(free) // (parts - p)
        own = [max(free, key=lambda i: (corr[i, free].max(), -i))]
        free.remove(own[0])
        while len(own) < width:
            own.append(max(free, key=lambda i: (corr[i, own].sum(), -i)))
            free.remove(own[-1])
        out.append(sorted(own))
    return out


def part_value(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of a part, packed."""
    out = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def balls(width: int, radius: int) -> np.ndarray:
    """Masks of up to radius bits of a part."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.uint64)


def _bucket(values: np.ndarray) -> np.ndarray:
    return ((values + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS_LOG2)


class Plan:
    """Partitions, counts of fingerprints by partition and bucket, and from which count on a bucket is hot."""

    def __init__(self, bits: list[list[int]], counts: np.ndarray, max_bits: int = MAX_BITS):
        self.bits, self.counts, self.max_bits = bits, counts, max_bits
        self.hot = max(HOT, HOT_MEAN * int(counts[0].sum()) >> BUCKETS_LOG2) if len(counts) else HOT
        parts = len(bits)
        #: Threshold vectors that obey the generalised pigeonhole principle.
        self.options = [t for t in product(range(-1, max_bits + 1), repeat=parts) if sum(t) == max_bits - parts + 1]

    def thresholds(self, fp: np.ndarray) -> np.ndarray:
        """For each fingerprint and partition, the thresholds of least estimated cost: candidates and probes.
        Hot buckets count as the neighbours that have to be emitted instead. Dynamic programming over the
        partitions: cost[s] is the least cost at which those so far have thresholds of sum s - parts."""
        parts, n = len(self.bits), len(fp)
        if not n:
            return np.zeros((0, parts), np.int64)
        inf = np.float64(1e18)
        span = parts * (self.max_bits + 1) + 1  # sums -parts .. parts * max_bits
        cost = np.full((n, span), inf)
        cost[:, 0] = 0
        choices = []
        for p, bits in enumerate(self.bits):
            value = part_value(fp, bits)
            own = [np.zeros(n)]
            for t in range(self.max_bits + 1):
                if any(o[p] == t for o in self.options):
                    found = self.counts[p][_bucket(value[:, None] ^ balls(len(bits), t)[None, :])].astype(np.float64)
                    own.append(np.where(found >= self.hot, 65.0 * 64, found).sum(1) + found.shape[1])
                else:
                    own.append(np.full(n, inf))
            new, pick = np.full((n, span), inf), np.zeros((n, span), np.int8)
            for j, c in enumerate(own):  # threshold j - 1 adds j to the index
                if j:
                    moved = np.full((n, span), inf)
                    moved[:, j:] = cost[:, :-j] + c[:, None]
                else:
                    moved = cost + c[:, None]
                better = moved < new
                new[better] = moved[better]
                pick[better] = j
            cost = new
            choices.append(pick)
        at = np.full(n, self.max_bits + 1)  # the sum max_bits - parts + 1
        out = np.zeros((n, parts), np.int64)
        for p in range(parts - 1, -1, -1):
            j = choices[p][np.arange(n), at].astype(np.int64)
            out[:, p] = j - 1
            at = at - j
        return out


def make_plan(distinct: DataFrame, max_bits: int = MAX_BITS, parts: int = PARTS) -> Plan:
    total = distinct.count()
    sample = distinct if total <= SAMPLE else distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1_000_000)) < int(1_000_000 * SAMPLE / total))
    bits = partition_bits(np.sort(sample.select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)), parts)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for p, own in enumerate(bits):
                k, n = np.unique(_bucket(part_value(fp, own)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), p, np.int64)), pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))], ["part", "bucket", "n"])

    # at most parts * 2**BUCKETS_LOG2 rows, whatever the input
    found = distinct.select("fp").mapInArrow(buckets, "part long, bucket long, n long").groupBy("part", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((parts, 1 << BUCKETS_LOG2), np.int64)
    counts[found["part"].to_numpy(int), found["bucket"].to_numpy(int)] = found["n"].to_numpy()
    return Plan(bits, counts, max_bits)


# -- links --------------------------------------------------------------------------------------------

_KEYS = "part long, value long, fp long"


def _keys(plan: Plan, probes: bool):
    """Rows (part, value, fp) of the index or of the probes; part -1: the centres of fingerprints that bear
    or probe a hot value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(part: int, value: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), part, np.int64)), pa.array(value.view(np.int64)), pa.array(fp.view(np.int64))], ["part", "value", "fp"])

        for b in batches:
            everything = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(everything), 2000):
                fp = everything[at : at + 2000]
                dense = np.zeros(len(fp), bool)
                t = plan.thresholds(fp) if probes else np.zeros((len(fp), len(plan.bits)), np.int64)
                for p, bits in enumerate(plan.bits):
                    value = part_value(fp, bits)
                    hot_own = plan.counts[p][_bucket(value)] >= plan.hot
                    dense |= hot_own
                    if not probes:
                        yield rows(p, value[~hot_own], fp[~hot_own])
                        continue
                    for r in range(plan.max_bits + 1):
                        who = np.flatnonzero(t[:, p] == r)
                        if len(who):
                            near = value[who][:, None] ^ balls(len(bits), r)[None, :]
                            hot = plan.counts[p][_bucket(near)] >= plan.hot
                            dense[who] |= hot.any(1)
                            yield rows(p, near[~hot], np.broadcast_to(fp[who][:, None], near.shape)[~hot])
                if probes and dense.any():
                    centres = np.append(np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0))
                    own = fp[dense]
                    yield rows(-1, (own[:, None] ^ centres[None, :]).ravel(), np.repeat(own, 65))

    return run


def links(distinct: DataFrame, plan: Plan) -> DataFrame:
    """a, b: pairs of different fingerprints that are close, enough of them to connect all that are. Those
    that meet in a centre are each linked to the least of them."""
    if plan.max_bits != 2:
        raise ValueError("the centres of hot values are for two differing bits")
    fps = distinct.select("fp")
    probe = settle(fps.mapInArrow(_keys(plan, True), _KEYS))
    index = fps.mapInArrow(_keys(plan, False), _KEYS)
    close = (F.bit_count(F.col("p.fp").bitwiseXOR(F.col("i.fp"))) <= plan.max_bits) & (F.col("p.fp") != F.col("i.fp"))
    found = probe.where("part >= 0").alias("p").join(index.alias("i"), (F.col("p.part") == F.col("i.part")) & (F.col("p.value") == F.col("i.value")) & close)
    found = found.select(F.col("p.fp").alias("a"), F.col("i.fp").alias("b"))
    centre = probe.where("part = -1").groupBy("value").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    star = centre.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 65)).alias("b"))
    pairs = found.unionAll(star)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest id that links reach, its own included.

    Equal fingerprints always link, so copies are one node however many they are. A null id takes part but
    is never the smallest, unless no other is there. An empty table gives no rows. Only doc_id and text are
    read.
    """
    prints = settle(fingerprints(docs))
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    pairs = settle(links(distinct, make_plan(distinct)))
    labels = connected_components(pairs)
    # component of each linked fingerprint, then its smallest id
    member = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = settle(member.groupBy("component").agg(F.min("least").alias("component_id")))
    of_print = settle(member.join(smallest, "component").select("fp", "component_id"))
    # two plain tables: a fingerprint with a large share of the rows is split by the adaptive join
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
