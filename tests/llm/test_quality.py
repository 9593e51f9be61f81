import numpy as np

from clausemill.llm import quality
from clausemill.llm.queries import op6_quality_ftrl

DATA = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    for s in np.unique(score):  # ties get their mean rank
        rank[score == s] = rank[score == s].mean()
    ones = label == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_held_out_order(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    rows = op6_quality_ftrl(spark, DATA).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    own = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert len(own) > 40
    assert auc(np.array([x[0] for x in own]), np.array([x[1] for x in own])) > 0.8


def test_updates_against_the_formulas():
    """Follow the regularised leader, coordinate by coordinate in plain Python."""
    r = np.random.default_rng(2)
    rows = [(np.unique(r.integers(1, 50, 6)), None) for _ in range(40)]
    rows = [(i, r.random(len(i))) for i, _ in rows]
    labels = r.integers(0, 2, 40).astype(float)
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= quality.L1 else -(zi - np.sign(zi) * quality.L1) / ((quality.BETA + n.get(i, 0.0) ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(2):
        for (index, value), y in zip(rows, labels):
            w = [weight(i) for i in index]
            p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, value))))
            for i, v, wi in zip(index, value, w):
                g = (p - y) * v
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * wi, n.get(i, 0.0) + g * g
    got = quality.ftrl(rows, labels, epochs=2)
    assert np.allclose(got[:50], [weight(i) for i in range(50)])


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "good text " * 20_000, 5), (4, "bad", 5), (4, "bad", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (4, 0), (9, 1)], "doc_id long, quality int")
    train, rows = quality.labelled(docs, labels, lambda x: x > 0)
    w = quality.fit(train, rows)
    found = quality.score(docs, w).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (1, 2)}) == 1
    none = quality.fit(*quality.labelled(docs, labels.limit(0), lambda x: x > 0))
    assert (none == 0).all() and {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), w).count() == 0
