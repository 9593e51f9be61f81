"""Ranks, merges and reciprocal rank fusion of signals(query_id, signal, chunk_id, score, rank)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def ranked(scored: DataFrame, signal: str, limit: int, tie: str = "chunk_id") -> DataFrame:
    """The best `limit` of each query, by score rounded to 9 places and then the tie column."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), tie)
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return top.select("query_id", F.lit(signal).alias("signal"), "chunk_id", "score", "rank")


def concatenated(per_term: DataFrame, limit: int, stop_when_full: bool = False) -> DataFrame:
    """One list for each query from lists of terms(query_id, term_pos, chunk_id, rank), in the order of the
    terms; a chunk counts where it is first seen. With stop_when_full, terms after the one that fills the
    list don't count - which leaves the cut list the same."""
    first = per_term.groupBy("query_id", "chunk_id").agg(F.min(F.struct("term_pos", "rank")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "chunk_id")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "chunk_id", "rank")


def rrf(signals: DataFrame, k: int = RRF_K, order: Sequence[str] = ()) -> DataFrame:
    """query_id, chunk_id, score: sums of 1 / (k + rank); ties go to the signal first in order, then to rank."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("signal")) if order else F.lit(0)
    each = signals.withColumn("place", place)
    return each.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("place", "rank")).alias("first"))


def fused(signals: DataFrame, top: int, k: int = RRF_K, order: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "first", "chunk_id")
    return rrf(signals, k, order).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "chunk_id", "score", "rank")


def merge_lists(lists: Sequence[DataFrame], limit: int) -> DataFrame:
    """Lists(query_id, chunk_id, rank) after each other, each chunk once, cut and ranked anew."""
    each = [df.select("query_id", "chunk_id", F.lit(i).alias("src"), F.col("rank").alias("r")) for i, df in enumerate(lists)]
    both = each[0]
    for more in each[1:]:
        both = both.unionAll(more)
    first = both.groupBy("query_id", "chunk_id").agg(F.min(F.struct("src", "r")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "chunk_id")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "chunk_id", "rank")


def fill(head: DataFrame, rest: Sequence[DataFrame], limit: int) -> DataFrame:
    """head, filled up from further lists where it is short."""
    return merge_lists([head, *rest], limit)


def best_score(scored: DataFrame) -> DataFrame:
    """query_id, chunk_id, score: of several rows of a chunk, the one that scores best."""
    return scored.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def parcel(rank: Column, size: int = 5) -> Column:
    return F.floor((rank - 1) / size)
