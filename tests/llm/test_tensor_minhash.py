import random

import numpy as np
import pytest

from clausemill.llm import tensor_minhash
from clausemill.llm.common import Tables


def sets(docs, words=4):
    out = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        out[i] = {b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    return out


def plainly(docs):
    found = sets(docs)
    pairs = [(i, j) for i in found for j in found if i < j and found[i] and 100 * len(found[i] & found[j]) >= 80 * len(found[i] | found[j]) > 0]
    top = {i: i for i in found}
    for _ in found:
        for a, b in pairs:
            top[a] = top[b] = min(top[a], top[b])
    return {i: (len(found[i]), top[i], top[i] == i) for i in found}


def found(spark, docs, extra=()):
    df = spark.createDataFrame([(*d, *(1 for _ in extra)) for d in docs], "doc_id long, text string" + "".join(f", {c} int" for c in extra))
    return {r.doc_id: tuple(r)[1:] for r in tensor_minhash.near_duplicates(df).collect()}


def words(seed, n, of=3000):
    r = random.Random(seed)
    return [f"w{r.randrange(of)}" for _ in range(n)]


def test_near_copies_and_others(spark):
    docs, at = [], 0
    for g in range(12):
        base = words(g, 80 + 10 * g)
        for k in range(4):
            v = list(base)
            for i in random.Random(100 * g + k).sample(range(len(v)), k):
                v[i] = f"x{at}"
            docs.append((at, " ".join(v)))
            at += 1
    docs += [(500, ""), (501, None), (502, " \t"), (503, "a b"), (504, "A  B"), (505, "a b c"), (506, docs[0][1].upper())]
    assert found(spark, docs) == plainly(docs)


def test_the_threshold_is_exact(spark):
    """40 of 50 shingles shared is a link, 39 of 50 is none."""
    w = words(1, 48)
    docs = [(0, " ".join(w)), (1, " ".join([*w[:43], *(f"y{i}" for i in range(5))]))]
    s = sets(docs)
    assert (len(s[0] & s[1]), len(s[0] | s[1])) == (40, 50)
    assert found(spark, docs)[1][1] == 0
    docs[1] = (1, " ".join([*w[:42], *(f"y{i}" for i in range(5))]))
    s = sets(docs)
    assert 100 * len(s[0] & s[1]) < 80 * len(s[0] | s[1])
    assert found(spark, docs)[1][1] == 1


def test_a_large_group_and_a_common_passage(spark):
    w, passage = words(5, 150), words(6, 60)
    docs = []
    for i in range(300):
        v = list(w)
        v[random.Random(i).randrange(150)] = f"only{i}"
        docs.append((i, " ".join(v)))
    docs += [(1000 + i, " ".join(passage + words(50 + i, 40))) for i in range(60)]
    assert found(spark, docs) == plainly(docs)


def test_an_exact_join_for_crowds(spark, monkeypatch):
    """Sets that share most of their shingles without linking crowd the buckets; pairs among them that do link are found."""
    monkeypatch.setattr(tensor_minhash, "CHECKS", 100)
    base, docs = words(9, 100), []
    for i in range(80):
        r = random.Random(i)
        v = list(base)
        for k in r.sample(range(100), 6):
            v[k] = f"z{i}_{k}"
        docs.append((2 * i, " ".join(v)))
        if i % 3 == 0:
            v[r.randrange(100)] = "other"
            docs.append((2 * i + 1, " ".join(v)))
    assert found(spark, docs) == plainly(docs)
    tables = Tables(spark)
    ids = [i for i, _ in docs]
    all_sets = spark.createDataFrame([(i, bytearray(tensor_minhash.shingles(t, 4).tobytes())) for i, t in docs], "nid long, shingles binary")
    hashes = {i: tensor_minhash.shingles(t, 4) for i, t in docs}
    crowd = spark.createDataFrame([(i, len(h), [int(x) for x in tensor_minhash.bitmap(h)]) for i, h in hashes.items()], "nid long, n long, bits array<long>")
    none = spark.createDataFrame([], "node long, component long")
    pairs = {tuple(p) for p in tensor_minhash.by_prefixes(tables, crowd, all_sets, none).collect()}
    s = sets(docs)
    real = {(a, b) for a in ids for b in ids if a < b and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])}
    assert real and real <= pairs


@pytest.mark.parametrize("share", [0.8, 0.9])
def test_tables_find_pairs_at_the_threshold(share):
    """Of 3,000 pairs at a similarity, how many share a table."""
    r = np.random.default_rng(4)
    n, hit = 200, 0
    both = round(2 * n * share / (1 + share))
    for _ in range(3000):
        x = r.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
        a, b = (tensor_minhash.collections(s) for s in (x[:n], x[n - both :]))
        same = (a == b).reshape(2, -1).any(1)
        hit += same.all()
    assert hit >= 2998


def test_nulls_repeats_and_clashing_columns(spark):
    assert found(spark, []) == {}
    extra = ("nid", "key", "set", "n", "a", "b", "node", "component", "of")
    docs = [(1, "p q r s t u v"), (2, "P q r s t u v"), (3, "long " * 30_000 + "end")]
    assert found(spark, docs, extra) == plainly(docs)
    df = spark.createDataFrame([(None, "p q r s t"), (7, "p q r s t"), (7, "p q r s t"), (None, "alone here"), (None, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in tensor_minhash.near_duplicates(df).collect()))
    assert rows == [(0, 0, 0, True), (0, 1, 0, True), (0, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True)]


def test_each_pair_comes_from_the_first_table_it_meets_in(spark):
    r = np.random.default_rng(8)
    b = tensor_minhash.BANDS
    rows = []
    for _ in range(60):
        x = r.integers(0, 3, 2 * b).tolist()
        y = r.integers(0, 3, 2 * b).tolist()
        rows += [(len(rows) // (b * b), x, y, t) for t in range(b * b)]
    df = spark.createDataFrame(rows, "k long, x array<long>, y array<long>, t int")
    found = {}
    for k, x, y, t in df.where(tensor_minhash.first_met(df.x, df.y, df.t)).where("x[floor(t / 10)] = y[floor(t / 10)] and x[10 + t % 10] = y[10 + t % 10]").collect():
        found.setdefault(k, []).append(t)
    for k, x, y, _ in rows[:: b * b]:
        meet = [i * b + j for i in range(b) for j in range(b) if x[i] == y[i] and x[b + j] == y[b + j]]
        assert found.get(k, []) == meet[:1]
