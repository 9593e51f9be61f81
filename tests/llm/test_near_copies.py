import random

import corpus_pipeline
from clausemill.llm import near_copies

SMALL = "/root/testdata/sf0.01"


def sets(docs):
    out = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        out[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def near_pairs(docs):
    s = sorted(sets(docs).items(), key=lambda x: len(x[1]))
    out = []
    for k, (i, a) in enumerate(s):
        for j, b in s[k + 1 :]:
            if len(b) * 4 > len(a) * 5:
                break
            both = len(a & b)
            if both * 5 >= (len(a) + len(b) - both) * 4:
                out.append((i, j))
    return out


def firsts(ids, pairs):
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    return {find(i) for i in ids}


def kept(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SMALL).collect())


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def test_one_changed_word(spark):
    docs = []
    for i in range(20):
        w = words(i, 60)
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:30], "other", *w[31:]]))]
    assert kept(spark, docs) == [2 * i for i in range(20)]


def test_less_similar_stays(spark):
    w = words(1, 60)
    docs = [(0, " ".join(w)), (1, " ".join([*w[:20], "x", *w[21:40], "y", *w[41:]])), (2, "a b"), (3, "a c"), (4, ""), (5, " "), (6, None), (7, "A  b")]
    assert kept(spark, docs) == [0, 1, 2, 3, 4]


def test_documents_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    pairs = near_pairs(docs)
    assert any(a != b for a, b in pairs)
    assert set(kept(spark, docs)) == firsts([i for i, _ in docs], pairs)


def test_a_large_group_of_near_copies(spark):
    w = words(5, 200)
    docs = []
    for i in range(400):
        v = list(w)
        v[random.Random(i).randrange(200)] = f"only{i}"
        docs.append((i, " ".join(v)))
    assert kept(spark, docs) == [0]


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "A b c d"), (4, "other words here"), (None, "quite another text")], "doc_id long, text string")
    found = near_copies.keep_one(df)
    assert found.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in found.collect()) == [(0, "quite another text"), (4, "A b c d"), (4, "other words here")]
    assert near_copies.keep_one(df.limit(0)).count() == 0


def test_ids_that_stand_twice(spark):
    """A text isn't lost because another with its id goes."""
    df = spark.createDataFrame([(1, "a b c d e f"), (5, "a b c d e f"), (5, "quite another text")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in near_copies.keep_one(df).collect()) == [(1, "a b c d e f"), (5, "quite another text")]
