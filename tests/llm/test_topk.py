import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from twins import differences

from clausemill.llm import queries, topk


def brute(rows, k, every):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q is not None and q % every == 0:
            found = [(-sum(a * b for a, b in zip(v, w)), i is None, i or 0, i) for i, w in good if i != q and len(w) == len(v)]
            out += [(q, n + 1, f[3], -f[0]) for n, f in enumerate(sorted(found)[:k])]
    return sorted(out)


def found(df, **how):
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 4 == 0, 5, **how).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("how", [{}, {"candidates": 16, "queries": 5}])
def test_ties_copies_nulls_and_lengths(spark, how):
    r = random.Random(4)
    nan = float("nan")
    rows = [(i, [r.choice([-1.0, -0.5, -0.001, 0.0, 0.3, 1.0]) for _ in range(4)]) for i in range(120)]
    rows += [(120, None), (121, [None, 1.0, 1.0, 1.0]), (124, [nan, 0.0, 0.0, 0.0]), (128, [float("inf"), 0.0, 0.0, 0.0]), (132, [0.0] * 4), (136, [1.0, 2.0]), (140, []), (144, []), (None, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, c string").repartition(3)
    assert found(df, **how) == brute(rows, 5, 4)
    assert found(df.limit(0), **how) == []


def test_the_walk_stops_early_and_is_exact():
    r = np.random.default_rng(1)
    vectors = np.floor(256 * r.standard_normal((3000, 3))).astype(np.int64)
    lists = topk.SortedLists(vectors)
    for q in range(20):
        rows, score = lists.search(vectors[q], 7, np.array([q]))
        every = vectors @ vectors[q]
        every[q] = -(2**62)
        assert rows.tolist() == np.lexsort((np.arange(3000), -every))[:7].tolist()
        assert score.tolist() == every[rows].tolist()


def test_embeddings(spark):
    name = "op9_threshold_topk"
    assert differences(spark, "/root/testdata/sf0.001", queries.QUERIES[name], queries.SQL[name]) == ""
