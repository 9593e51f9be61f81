import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from clausemill.llm import chunk_recipes as c
from clausemill.llm.common import text_blocks

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(docs):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for i, t in docs:
        groups.setdefault(norm(t), []).append(i)
    return sorted((i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in docs)


def test_groups(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdefgh \n\t") for _ in range(200_000))
    texts = ["", None, " ", "\n\t ", "a b", "a  b", " a b", "a b ", "a\x0bb", "a b", "a\x1cb", "é b", long, long.replace("\n", " "), long[:-1] + "z", "x" * 150_000, "x" * 150_001]
    docs = list(enumerate(texts)) + list(enumerate(texts[::2], 100))
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, recipe string, uid int").repartition(3)
    assert sorted(map(tuple, c.exact_duplicates(df).select(COLUMNS).collect())) == brute(docs)
    kept = c.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted({x[1] for x in brute(docs)})
    assert c.exact_duplicates(df.limit(0)).count() == 0
    assert c.keep_first(df.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (7, "a"), (7, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    found = c.exact_duplicates(df).collect()
    assert sum(r.kept for r in found) == 2
    assert {(r.doc_id, r.keep_id, r.group_size) for r in found} == {(None, 7, 3), (7, 7, 3), (None, None, 2)}


def test_chunks_follow_content():
    r = random.Random(1)
    text = "".join(r.choice("abcdefghijkl ") for _ in range(60_000))
    texts = [text, "in front " + text, "x" * (3 * c.MAX_CHUNK), "", "ab"]
    borders = []
    for _, _, data, offsets in text_blocks(pa.array(texts), 1 << 30):
        for (s, e), b in zip(zip(offsets, offsets[1:]), c.cuts(data, offsets)):
            assert (b == [] and s == e) or (b[0] == s and b[-1] == e and (np.diff(b) > 0).all() and max(np.diff(b)) <= c.MAX_CHUNK)
            borders.append({e - x for x in b[1:-1]})
    assert borders[0] and len(borders[0] - borders[1]) <= 1
