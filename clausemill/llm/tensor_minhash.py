"""MinHash near-dedup by tensored banding, with every link confirmed on whole shingle sets.

A set has two small collections of BANDS keys, each made of ROWS minima. A table's key combines a pair, one key of each
collection, so 2 * BANDS keys make BANDS**2 tables: with BANDS = 10 and ROWS = 2 forty minima serve a hundred tables of
four minima, which plain banding would need four hundred for. A pair of sets at similarity s shares a table with
probability (1 - (1 - s**ROWS)**BANDS)**2, which is 0.9999 at 0.8.

Links are found in rounds, each only between what the links before leave apart: each set with the one of its buckets'
hubs that it shares most tables with, a hub being the member that meets most others; with the other hubs; and the
members of buckets that are still of several components, those outside the largest with all others. Of all pairs only
those go on whose bitmaps differ in no more bits than sets at 4/5 can, which the join itself tells. A bucket that would
take more than CHECKS of these tests is too crowded for a task; its members go through an exact join on prefixes: two
sets at 4/5 share one of the first fifth of their shingles, the rarest first. So none is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Tables
from .components import connected_components

#: Least similarity, as a fraction of whole numbers so that the comparison is exact.
LEAST = (4, 5)
BANDS, ROWS = 10, 2
SEED = 42
#: Tests of two bitmaps that a bucket may take in its task, about a second's work.
CHECKS = 1 << 24
#: Sets that hold a rare shingle, at most.
RARE = 16
#: Words of 64 bits in a set's bitmap.
BITMAP = 8
#: Keys of texts that are sent to all tasks instead of moving texts.
SENT = 500_000
#: Shingles of which minima are taken in one step.
STEP = 4096

_RANDOM = np.random.default_rng(11)
_XOR = _RANDOM.integers(0, 1 << 64, 2 * BANDS * ROWS, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 1 << 64, 2 * BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


# -- sets ---------------------------------------------------------------------------------------------


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes, in order, of so many consecutive words each; a shorter text is one shingle, one without
    words has none. ASCII case and blanks don't count."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    count = max(1, len(found) - words + 1)
    return np.unique(np.fromiter((digest(b" ".join(found[i : i + words]), SEED) for i in range(count)), np.uint64, count))


def collections(found: np.ndarray) -> np.ndarray:
    """The keys of both collections, 2 * BANDS of them."""
    least = np.full(2 * BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), STEP):
        mixed = (found[at : at + STEP, None] ^ _XOR) * _ODD
        mixed ^= mixed >> np.uint64(29)
        least = np.minimum(least, mixed.min(0))
    each = least.reshape(2 * BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(each[i].tobytes(), i) for i in range(2 * BANDS)], np.uint64).view(np.int64)


def bitmap(found: np.ndarray) -> np.ndarray:
    """Bits that an odd number of the shingles fall on. Each bit in which two bitmaps differ needs a shingle that only one
    of the sets has, so sets differ in as many shingles at least."""
    odd = np.bincount((found >> np.uint64(40)).astype(np.int64) % (64 * BITMAP), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= (len(a) + len(b) - both) * LEAST[0]


def _printed(words: int, fingerprints: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, size, keys, bits, prints = [], [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), words)
                sets.append(xxhash.xxh3_128_digest(found.tobytes()))
                size.append(len(found))
                keys.append(collections(found))
                bits.append(bitmap(found))
                prints.append(simhash.fingerprint(found) if fingerprints else 0)
            lists = lambda x, n, rows=len(sets): pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * n), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)))
            columns = [batch.column(0), batch.column(1), pa.array(sets, pa.binary()), pa.array(size, pa.int64()), lists(keys, 2 * BANDS), lists(bits, BITMAP), pa.array(np.array(prints, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "set", "n", "keys", "bits", "fp"])

    return run


def prints(docs: DataFrame, words: int, fingerprints: bool = False) -> DataFrame:
    """doc_id, text_key, set (a digest of it), n, keys, bits, fp for each row of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(_printed(words, fingerprints), f"doc_id {kind}, text_key long, set binary, n long, keys array<long>, bits array<long>, fp long")


def nodes_of(printed: DataFrame) -> DataFrame:
    """nid, set, n, keys, bits, fp, first (none, doc_id, text_key): a row for each different set, with the first document that
    has it, one without an id only if no other is there."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key"))).alias("first")
    each = printed.groupBy("set").agg(first, *[F.first(c).alias(c) for c in ("n", "keys", "bits", "fp")])
    return each.withColumn("nid", F.monotonically_increasing_id())


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py(), words).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["nid", "shingles"])

    return run


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """nid, shingles (64-bit hashes in order) for wanted(nid, first)."""
    keys = wanted.select("nid", F.col("first.doc_id").alias("of"), F.col("first.text_key").alias("key"))
    if keys.count() <= SENT:
        keys = F.broadcast(keys)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    rows = rows.join(keys, F.col("doc").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("key")))
    return rows.groupBy("nid").agg(F.first("text").alias("text")).mapInArrow(_sets(words), "nid long, shingles binary")


# -- candidates ---------------------------------------------------------------------------------------


def members(tables: Tables, nodes: DataFrame) -> DataFrame:
    """key, nid, t, hub: a row for each table t in which a set shares its bucket. hub is the one of the bucket that meets most
    sets over all tables: what others were copied from, if it is there."""
    a, b = F.slice("keys", 1, BANDS), F.slice("keys", BANDS + 1, BANDS)
    pairs = F.flatten(F.transform(a, lambda x, i: F.transform(b, lambda y, j: F.xxhash64(x, y, i * BANDS + j))))
    each = nodes.select("nid", F.posexplode(pairs).alias("t", "key"))
    shared = tables.write("buckets", each.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    met = tables.write("met", each.join(shared, "key"))
    scored = met.join(met.groupBy("nid").agg(F.sum("size").alias("score")), "nid")
    hubs = scored.groupBy("key").agg(F.max(F.struct("score", "nid")).alias("hub"))
    member = tables.write("members", met.join(hubs, "key").select("key", "nid", "t", F.col("hub.nid").alias("hub")))
    tables.drop("buckets", "met")
    return member


def fits(na: Column, nb: Column, bits_a: Column, bits_b: Column) -> Column:
    """Whether two sets of these sizes and bitmaps can be as similar as LEAST: at s they differ in at most
    (1 - s) / (1 + s) of both sizes' sum."""
    differ = reduce(Column.__add__, [F.bit_count(F.get(bits_a, i).bitwiseXOR(F.get(bits_b, i))) for i in range(BITMAP)])
    sizes = F.least(na, nb) * LEAST[1] >= F.greatest(na, nb) * LEAST[0]
    return sizes & (differ * (LEAST[1] + LEAST[0]) <= (na + nb) * (LEAST[1] - LEAST[0]))


def fitting(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs(a, b, ...) that can be as similar as LEAST by what nodes(nid, n, bits) say."""
    of = lambda side: nodes.select(F.col("nid").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"bits_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(fits(*map(F.col, ("na", "nb", "bits_a", "bits_b")))).select(*pairs.columns)


def stars(member: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, hub, shared: each set with the hubs of its buckets, and the number of tables in which they meet; a is the
    lesser of both."""
    ends = member.where(F.col("nid") != F.col("hub")).groupBy("nid", "hub").agg(F.count("*").alias("shared"))
    return fitting(ends.select(F.least("nid", "hub").alias("a"), F.greatest("nid", "hub").alias("b"), "hub", "shared"), nodes)


def labelled(rows: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """rows with the component of the column node; a node without links is its own."""
    return rows.join(labels.select(F.col("node").alias(node), F.col("component").alias(label)), node, "left").withColumn(label, F.coalesce(label, node))


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends no link connects yet."""
    return labelled(labelled(pairs, labels, "a", "ca"), labels, "b", "cb").where("ca != cb").drop("ca", "cb")


def open_buckets(member: DataFrame, labels: DataFrame) -> DataFrame:
    """key, nid, comp, main, checks: the members(key, nid) of buckets that still hold several components; main is the one
    with most members, checks the number of pairs of those that aren't in it with all members."""
    known = labelled(member.drop("hub"), labels, "nid", "comp")
    parts = known.groupBy("key", "comp").agg(F.count("*").alias("c"))
    buckets = parts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("size")).where(F.col("main.c") < F.col("size"))
    return known.join(buckets.select("key", F.col("main.comp").alias("main"), ((F.col("size") - F.col("main.c")) * F.col("size")).alias("checks")), "key")


def first_met(x: Column, y: Column, t: Column) -> Column:
    """Whether t is the first table in which sets with the keys x and y meet: of each collection, the first key they share."""
    i, j = F.floor(t / BANDS), t % BANDS
    differ = lambda at, own: (own <= at % BANDS) | (F.get(x, at) != F.get(y, at))
    return reduce(Column.__and__, [differ(at, i) for at in range(BANDS - 1)] + [differ(BANDS + at, j) for at in range(BANDS - 1)])


def across(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: of open buckets, those outside the largest component with all others that can be as similar as LEAST; in
    buckets of tables, a pair comes from the first that it meets in."""
    tables = "t" in found.columns
    some = found.join(nodes.select("nid", "n", "bits", *(["keys"] if tables else [])), "nid")
    x, y = some.where(F.col("comp") != F.col("main")).alias("x"), some.alias("y")
    may = fits(*(F.col(c) for c in ("x.n", "y.n", "x.bits", "y.bits")))
    if tables:
        may = may & (F.col("x.t") == F.col("y.t")) & first_met(F.col("x.keys"), F.col("y.keys"), F.col("x.t"))
    both = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & may)
    return both.select(F.least("x.nid", "y.nid").alias("a"), F.greatest("x.nid", "y.nid").alias("b")).distinct()


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1).slice(at, 500)]
            nid = np.repeat(batch.column(0).slice(at, 500).to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(nid), pa.array(np.concatenate(sets))], ["nid", "token"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """nid, shingles, rare (those of them that few sets hold) -> nid, key for each shingle of the prefix."""
    for batch in batches:
        nids, keys = [], []
        for nid, whole, few in zip(*batch.columns, strict=True):
            found = np.frombuffer(whole.as_buffer(), np.int64)
            rare = np.sort(np.array(few.as_py() or [], np.int64))
            order = np.concatenate([rare, np.setdiff1d(found, rare, assume_unique=True)])
            first = len(found) + (-len(found) * LEAST[0] // LEAST[1]) + 1
            nids.append(np.full(first, nid.as_py()))
            keys.append(order[:first])
        if nids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nids)), pa.array(np.concatenate(keys))], ["nid", "key"])


def by_prefixes(tables: Tables, crowd: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b: every pair of crowd(nid, n, bits) of two components that can be as similar as LEAST, by an exact join.

    Of two sets of m and n shingles at similarity s or more, the first m - ceil(s * m) + 1 of the one and as many of the
    other in a common order share one. In the order taken here, shingles that more than RARE sets hold come last, so
    that what many texts share makes no pairs.
    """
    mine = tables.write("crowd_sets", sets.join(crowd.select("nid"), "nid", "left_semi"))
    each = mine.select("nid", "shingles").mapInArrow(_tokens, "nid long, token long")
    common = each.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > RARE).select("token")
    rare = each.join(common, "token", "left_anti").groupBy("nid").agg(F.collect_list("token").alias("rare"))
    kept = mine.join(rare, "nid", "left").select("nid", "shingles", "rare").mapInArrow(_prefixes, "nid long, key long")
    return across(tables.write("open_prefixes", open_buckets(tables.write("prefixes", kept), labels)), crowd)


# -- links --------------------------------------------------------------------------------------------


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
    for batch in batches:
        good = [similar(read(x), read(y)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the pairs that are as similar as LEAST says or more."""
    both = pairs.select("a", "b").join(sets.select(F.col("nid").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("nid").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long")


class Links:
    """Components of the links found so far; each new set of pairs is verified and joins components."""

    def __init__(self, tables: Tables, sets: DataFrame):
        self.tables, self.sets, self.rounds = tables, sets, 0
        self.labels = self.tables.spark.createDataFrame([], "node long, component long")

    def add(self, pairs: DataFrame) -> None:
        """Only what is contracted to components is solved anew."""
        self.rounds += 1
        found = labelled(labelled(verified(pairs, self.sets), self.labels, "a", "ca"), self.labels, "b", "cb")
        found = self.tables.write("links", found.where("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        if not found.limit(1).count():
            return
        merged = connected_components(found).select(F.col("node").alias("old"), F.col("component").alias("new"))
        joined = self.labels.join(merged, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
        # a node that had no label yet is its own component
        known = joined.unionAll(merged.select(F.col("old").alias("node"), F.col("new").alias("component")))
        self.labels = self.tables.write("labels", known.groupBy("node").agg(F.min("component").alias("component")))


def components(tables: Tables, docs: DataFrame, nodes: DataFrame, words: int, more: DataFrame | None = None) -> DataFrame:
    """node, component: what links of nodes(nid, n, keys, bits, first) connect; nodes without links may be missing.
    more(a, b): candidates of another kind, compared in the first round."""
    member = members(tables, nodes)
    star = tables.write("stars", stars(member, nodes))
    wanted = [member.select("nid")]
    if more is not None:
        more = tables.write("more", fitting(more, nodes))
        wanted.append(more.select(F.explode(F.array("a", "b")).alias("nid")))
    wanted = nodes.select("nid", "first").join(reduce(DataFrame.unionAll, wanted).distinct(), "nid", "left_semi")
    sets = tables.write("sets", sets_of(docs, tables.write("wanted", wanted), words))
    links = Links(tables, sets)
    near = F.when(F.col("a") == F.col("hub"), F.col("b")).otherwise(F.col("a"))
    best = star.groupBy(near.alias("nid")).agg(F.max(F.struct("shared", "a", "b")).alias("best")).select("best.a", "best.b")
    links.add((best if more is None else best.unionAll(more)).distinct())
    links.add(apart(star.select("a", "b").distinct(), links.labels))
    found = tables.write("open", open_buckets(member, links.labels))
    links.add(across(found.where(F.col("checks") <= CHECKS), nodes).join(star, ["a", "b"], "left_anti"))
    crowd = found.where(F.col("checks") > CHECKS).select("nid").distinct()
    if crowd.limit(1).count():
        crowd = tables.write("crowd", nodes.select("nid", "n", "bits").join(crowd, "nid", "left_semi"))
        links.add(by_prefixes(tables, crowd, sets, links.labels).join(star, ["a", "b"], "left_anti"))
    tables.drop("sets", "members", "open", "stars")
    return links.labels


def near_duplicates(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach, its own included), kept.

    Texts that have the same set link, so copies are one node however many they are. Null and empty texts and those
    without words have no set and link with nothing. A null id takes part, but its component's id is null only if no
    other is there; of rows that repeat an id, all are kept where one is. An empty table gives no rows. Texts are read
    whole; only doc_id and text are read.
    """
    tables = Tables(docs.sparkSession)
    printed = tables.write("prints", prints(docs, words))
    nodes = tables.write("nodes", nodes_of(printed.where("n > 0")))
    labels = components(tables, docs, nodes, words)
    of = labelled(nodes.select("nid", "set", F.col("first.doc_id").alias("least")), labels, "nid", "component")
    smallest = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = tables.write("answers", of.join(smallest, "component").select("set", "component_id", F.lit(True).alias("linked")))
    joined = printed.select("doc_id", "set", "n").join(of_set, "set", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
