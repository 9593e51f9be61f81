import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clausemill.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
T = Tokenizer.from_file(PATH)


def check(docs, rows):
    """Every piece has the place the contract gives it, and sequences are without gaps."""
    left = {}
    for i, text in docs:
        ids = T.encode(text or "", add_special_tokens=False).ids + [2]
        first, at, pieces = (len(ids) - 1) % 1024 + 1, 0, []
        while at < len(ids):
            n = 1024 if at else first
            pieces.append((len(pieces), at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
        left.setdefault(i, []).extend(pieces)
    for r in rows:
        left[r.doc_id].remove((r.piece, r.start, r.length, r.ids_crc32))
    assert not any(left.values())
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in fill.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    return len(fill)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    rows = packing.pack_documents(df, PATH).collect()
    bins = check(docs, rows)
    assert bins <= 1.01 * -(-sum(r.length for r in rows) // 1024) + 1


def test_edges(spark):
    text = "".join(random.Random(1).choice("abc de\n") for _ in range(60_000))
    exact = next(text[:n] for n in range(1500, 6000) if len(T.encode(text[:n]).ids) == 1023)
    docs = [(1, None), (2, ""), (3, text), (4, exact), (5, exact + "!"), (5, "a b"), (5, "a b"), (None, "c"), (7, "a<|endoftext|>b")]
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in docs], "doc_id long, text string, n int, uid string").repartition(3)
    check(docs, packing.pack_documents(df, PATH).collect())
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


@given(st.lists(st.integers(1, 30), max_size=60))
@settings(max_examples=200, deadline=None)
def test_local_search_keeps_pieces_and_never_adds_bins(lengths):
    start = packing.best_fit(lengths, 30)
    squares = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)
    before = squares(start), len(start)
    bins = packing.pack(lengths, size=30)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in b) <= 30 for b in bins)
    assert squares(bins) >= before[0] and len(bins) <= before[1]


def test_exchanges_empty_a_bin_that_best_fit_leaves():
    lengths = [6, 6, 4, 4, 5, 5]
    given = [[0, 2], [1, 4], [3, 5]]  # 10, 11, 9 of 12
    assert len(packing.local_search([list(b) for b in given], lengths, 15)) <= 3
    r = random.Random(8)
    fewer = 0
    for _ in range(20):
        lengths = [r.randint(200, 700) for _ in range(150)]
        fewer += len(packing.best_fit(lengths)) - len(packing.pack(lengths))
    assert fewer >= 0


def test_several_groups_and_rounds(spark):
    r = random.Random(3)
    lengths = [r.randint(1, 1023) for _ in range(900)]
    items = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    rows = packing.assign(items, group=200).collect()
    assert sorted(x.uid for x in rows) == list(range(900))
    fill = {}
    for x in rows:
        fill.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in fill.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist()
        assert sum(n for _, n in own) <= 1024
    assert len(fill) <= 1.04 * sum(lengths) / 1024 + 1
