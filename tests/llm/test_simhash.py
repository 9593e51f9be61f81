import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from clausemill.llm import simhash
from clausemill.llm.components import connected_components
from clausemill.llm.queries import op10_simhash_pigeonhole

SMALL = "/root/testdata/sf0.001"


def brute_print(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", lower)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, near):
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in near:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    return {i: top(i) for i in ids}


def brute(docs):
    f = {i: brute_print(t) for i, t in docs}
    near = [(a, b) for a in f for b in f if a < b and (f[a] ^ f[b]).bit_count() <= 2]
    return {i: (f"{f[i]:016x}", c) for i, c in components(f, near).items()}


def by_id(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def test_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert by_id(op10_simhash_pigeonhole(spark, SMALL)) == brute(docs)


def test_edge_texts(spark):
    texts = ["", None, " \n", "A b", "a B", "a b c", "É é", "x\x0by z", "x y z", "x y z", "long " * 9000]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, fp int, least string")
    assert by_id(simhash.near_duplicates(df)) == brute(docs)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "other words here")], "doc_id long, text string")
    found = simhash.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (0, 4), (4, 4), (4, 4)]


def clustered(seed, n=1500):
    """Fingerprints in chains and balls around few centres, some values shared by very many."""
    r = random.Random(seed)
    flip = lambda x, k: x ^ sum(1 << b for b in r.sample(range(64), k))
    centres = [r.getrandbits(64) for _ in range(8)] + [0]
    out = {flip(r.choice(centres), r.randint(0, 4)) for _ in range(n)}
    low = r.getrandbits(40) << 24
    out |= {low | r.getrandbits(24) for _ in range(n)}
    return sorted(out)


@pytest.mark.parametrize("hot", [None, 40])
def test_links_connect_all_that_are_close(spark, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(simhash, "HOT", hot)
        monkeypatch.setattr(simhash, "HOT_MEAN", 0)
    fps = clustered(hot or 0)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp long, least long").repartition(3)
    pairs = simhash.links(df, simhash.make_plan(df)).collect()
    assert all(((p.a ^ p.b) & (1 << 64) - 1).bit_count() <= 2 for p in pairs)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2]
    mask = (1 << 64) - 1
    assert components(fps, near) == components(fps, [(p.a & mask, p.b & mask) for p in pairs])


def test_thresholds_obey_the_principle_and_are_least():
    r = np.random.default_rng(3)
    fp = r.integers(0, 1 << 63, 300, dtype=np.int64).view(np.uint64)
    bits = simhash.partition_bits(fp)
    assert sorted(b for own in bits for b in own) == list(range(64))
    counts = r.integers(0, 300, (3, 1 << simhash.BUCKETS_LOG2))
    plan = simhash.Plan(bits, counts)
    got = plan.thresholds(fp)
    assert (got.sum(1) == 0).all() and got.min() >= -1 and got.max() <= 2

    def cost(i, t):
        total = 0
        for p, own in enumerate(bits):
            if t[p] >= 0:
                near = simhash.part_value(fp[i : i + 1], own)[:, None] ^ simhash.balls(len(own), t[p])[None, :]
                found = counts[p][simhash._bucket(near)]
                total += np.where(found >= plan.hot, 65.0 * 64, found).sum() + found.shape[1]
        return total

    for i in range(0, 300, 30):
        assert cost(i, got[i]) == min(cost(i, t) for t in plan.options)


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
@settings(max_examples=4, deadline=None)
def test_components(spark, edges):
    edges = [(a, b) for a, b in edges if a != b] or [(0, 1)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == components({x for e in edges for x in e}, edges)


def test_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)]
    random.Random(2).shuffle(edges)
    assert {r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == {0}
