"""Near-duplicates by Jaccard similarity of word shingles: SimHash candidates, and tensored minima where those can't reach.

Candidates come from two sources, and each is verified on the whole shingle sets.

* Fingerprints of the shingle sets within simhash.MAX_BITS bits, by the generalised pigeonhole (see simhash). All such
  pairs are found, however many near copies there are.
* At a similarity of 0.8, 64-bit SimHash fingerprints differ in 4 to 14 bits, where the generalised pigeonhole would
  compare a fixed share of all pairs. So sets also meet in the tables of tensor_minhash, in its rounds and with its exact
  join of what crowds a bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash, tensor_minhash
from .common import Tables

SHINGLE = 5
#: Rows to drop that are sent to all tasks instead of moving texts.
SENT = 500_000


def close_prints(tables: Tables, nodes: DataFrame) -> DataFrame:
    """a, b: nodes(nid, fp) whose fingerprints are equal or linked, each through the least node of a fingerprint."""
    distinct = tables.write("fingerprints", nodes.groupBy("fp").agg(F.min("nid").alias("least")))
    close = simhash.links(distinct, simhash.make_plan(distinct))
    of = lambda side: distinct.select(F.col("fp").alias(side), F.col("least").alias(f"of_{side}"))
    far = close.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("x"), F.col("of_b").alias("y"))
    equal = nodes.join(distinct, "fp").where(F.col("nid") != F.col("least")).select(F.col("least").alias("x"), F.col("nid").alias("y"))
    return tables.write("close", far.unionAll(equal).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each group that links connect: the one with the smallest id, or one without
    an id if no other is there; columns unchanged. Rows that repeat an id and a text aren't told apart. Texts without
    words are one group. An empty table gives no rows."""
    tables = Tables(docs.sparkSession)
    printed = tables.write("prints", tensor_minhash.prints(docs, SHINGLE, fingerprints=True))
    nodes = tables.write("nodes", tensor_minhash.nodes_of(printed))
    labels = tensor_minhash.components(tables, docs, nodes, SHINGLE, close_prints(tables, nodes.select("nid", "fp")))
    # component of each node, then its first document
    member = tensor_minhash.labelled(nodes.select("nid", "set", "first"), labels, "nid", "component")
    kept = member.groupBy("component").agg(F.min("first").alias("kept"))
    of_set = tables.write("kept", member.join(kept, "component").select("set", "kept"))
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_key") == F.col("kept.text_key"))
    gone = printed.select("doc_id", "text_key", "set").join(of_set, "set").where(~stays)
    gone = tables.write("gone", gone.select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__key")).distinct())
    if gone.count() <= SENT:
        gone = F.broadcast(gone)
    mine = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__doc"), F.xxhash64(F.col("text").cast("string")).alias("__text"))
    left = mine.join(gone, F.col("__doc").eqNullSafe(F.col("__gone")) & (F.col("__text") == F.col("__key")), "left_anti").select("__row.*")
    tables.drop(*[name for name in tables.paths if name != "gone"])
    return left
