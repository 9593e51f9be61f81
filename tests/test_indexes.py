"""Persisted indexes against the signals without them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.operators import retrieval
from clausemill.plans import retrieve
from clausemill.plans.retrieval_queries import _ask, _terms
from clausemill.sources import indexes
from clausemill.sources.derived import Views

SMALL = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def same(index, chunks, v):
    pairs = [
        (index.bm25(_ask(v)), retrieval.bm25(retrieve.corpus(chunks), _ask(v)), ("query_id", "chunk_id", "score")),
        (index.any_word(_terms(v), 40), retrieval.any_word(chunks, _terms(v), 40), ("query_id", "chunk_id", "rank")),
        (index.weighted_match(_terms(v)), retrieval.weighted_match(chunks, _terms(v)), ("query_id", "chunk_id", "score")),
        (index.trigram(_terms(v)), retrieval.trigram(chunks, _terms(v)), ("query_id", "term_pos", "chunk_id", "score")),
    ]
    for mine, plain, columns in pairs:
        assert rows(mine, *columns) == rows(plain, *columns)


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, SMALL)


def test_append_delete_and_append_again(spark, v, tmp_path):
    index = indexes.Postings(spark, str(tmp_path / "p"))
    one, two = v.chunks.where("id % 3 <> 0"), v.chunks.where("id % 3 = 0")
    index.append(one).append(two)
    same(index, v.chunks, v)
    gone = v.chunks.where("id % 4 = 1")
    index.delete(gone.select(F.col("id").alias("chunk_id")))
    left = v.chunks.where("id % 4 <> 1")
    same(index, left, v)
    back = gone.where("id % 8 = 1").withColumn("text", F.concat(F.lit("said anew: "), "text"))
    index.append(back)
    same(index, left.unionByName(back), v)


def test_only_folders_of_the_terms_are_read(spark, v, tmp_path):
    index = indexes.Postings(spark, str(tmp_path / "p")).append(v.chunks)
    whole = spark.read.parquet(f"{index.path}/words")
    asked = spark.createDataFrame([(0, 0, "the"), (0, 1, "of")], "query_id long, term_pos int, term string")
    words = asked.select(F.col("term").alias("word"))
    plan = index.words(words)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    held = {r.bucket for r in whole.select("bucket").distinct().collect()}
    read = {r.bucket for r in whole.where(F.col("word").isin("the", "of")).select("bucket").distinct().collect()}
    assert len(read) <= 2 < len(held)


def test_recall_of_the_lists(spark, v, tmp_path):
    small = Views(spark, "/root/testdata/sf0.1")
    index = indexes.Vectors(spark, str(tmp_path / "v")).build(small.embeddings, 100)
    queries = retrieve.query_vectors(small)
    exact = rows(retrieval.vectors(retrieve.chunk_vectors(small), queries, 20), "query_id", "chunk_id", "rank")
    assert rows(index.search(queries, 20, 100), "query_id", "chunk_id", "rank") == exact
    ids = lambda x: {(q, c) for q, c, _ in x}
    found = ids(rows(index.search(queries, 20, 75), "query_id", "chunk_id", "rank"))
    assert len(found & ids(exact)) >= 0.95 * len(exact)


def test_appended_and_odd_vectors(spark, tmp_path):
    r = np.random.default_rng(1)
    first = [(i, [float(x) for x in r.normal(size=4)]) for i in range(50)]
    df = lambda x: spark.createDataFrame(x, "vec_id long, embedding array<float>")
    index = indexes.Vectors(spark, str(tmp_path / "v")).build(df(first + [(99, None), (98, [0.0] * 4)]), 8)
    more = [(100 + i, [float(x) for x in r.normal(size=4)]) for i in range(20)]
    index.append(df(more))
    q = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.0, 0.0])], "query_id long, term_pos int, vector array<double>")
    found = [r.chunk_id for r in sorted(index.search(q, 70, 8).collect(), key=lambda r: r["rank"])]
    cos = {i: x[0] / np.linalg.norm(x) for i, x in ((i, np.array(x, np.float32).astype(float)) for i, x in first + more)}
    assert found == sorted(cos, key=lambda i: (-round(cos[i], 9), i))
