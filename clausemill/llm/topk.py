"""Exact top-k inner product search with Fagin's threshold algorithm.

Candidates lie in blocks of bounded size, each with one sorted list of its vectors for each dimension. A
query walks down the lists in step - from the top where its component is positive, from the bottom where it
is negative - scores what it meets and stops once the bound, the score of a vector that would stand at the
current depth in every list, is below its k-th best score. Blocks' results are merged by a ranked window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

CANDIDATES, QUERIES = 4096, 1024
FIRST_STEP = 16


class SortedLists:
    """A block's vectors, in the order of their ids, and their order in each dimension."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T  # dimension x rank
        self.values = np.take_along_axis(vectors.T, self.order, axis=1)

    def search(self, query: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best, ties to the smaller row; rows in skip don't count."""
        n = len(self.vectors)
        seen = np.zeros(n, bool)
        seen[skip] = True
        active = np.flatnonzero(query)
        if not len(active):
            rows = np.flatnonzero(~seen)[:k]
            return rows, np.zeros(len(rows), np.int64)
        up = (query[active] > 0)[:, None]
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, FIRST_STEP
        while depth < n:
            end = min(n, depth + step)
            at = np.arange(depth, end)[None, :]
            places = np.where(up, n - 1 - at, at)
            met = np.zeros(n, bool)
            met[self.order[active[:, None], places].ravel()] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            best, score = np.concatenate([best, new]), np.concatenate([score, self.vectors[new] @ query])
            first = np.lexsort((best, -score))[:k]
            best, score = best[first], score[first]
            bound = int(query[active] @ self.values[active, places[:, -1]])
            # at equality a vector not yet met could have the same score and a smaller id
            if len(best) == k and score[-1] > bound:
                break
            depth, step = end, step * 2
        return best, score


def top_k(vectors: DataFrame, is_query: Column, k: int, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for vectors(vec_id, embedding) and the queries among them.

    Components become floor(256 * x). Vectors that are null or hold null or non-finite components take no
    part; others meet vectors of their own length only. Rows that bear the query's id are not its
    candidates; a query that stands twice is answered twice. Null ids come after all others in ties and are
    no queries. Scores must fit a long. Only the two named columns are read.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    good = vectors.where(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("uid")
    )
    good = settle(good.withColumn("d", F.size("v")))
    sizes = good.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0)).alias("q")).first()
    c_blocks, q_blocks = -(-sizes["n"] // candidates) or 1, -(-sizes["q"] // queries) or 1
    block = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    mine = good.select("vec_id", "v", "d", block(c_blocks).alias("c"), all_of(q_blocks).alias("g"))
    asked = good.where("q").select("uid", "vec_id", "v", "d", block(q_blocks).alias("g"), all_of(c_blocks).alias("c"))
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("uid", pa.int64()), ("query_id", left.schema.field("vec_id").type), ("vec_id", left.schema.field("vec_id").type), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left = left.sort_by("vec_id")  # nulls last
        d = len(right.column("v")[0])
        matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(t.num_rows, d)
        lists, ids, q = SortedLists(matrix(left)), left.column("vec_id").to_pylist(), matrix(right)
        own: dict = {}
        for i, x in enumerate(ids):
            own.setdefault(x, []).append(i)
        uid, query, rows, scores = right.column("uid").to_pylist(), right.column("vec_id").to_pylist(), [], []
        for j in range(right.num_rows):
            found, score = lists.search(q[j], k, np.array(own.get(query[j], []), np.int64))
            rows += [(uid[j], query[j], ids[i]) for i in found.tolist()]
            scores += score.tolist()
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(3)] + [pa.array(scores, pa.int64())], schema=schema)

    key = ["d", "g", "c"]
    found = mine.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(search, f"uid long, query_id {kind}, vec_id {kind}, score long")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
