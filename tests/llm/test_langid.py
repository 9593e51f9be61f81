import numpy as np
import pyarrow as pa
import pytest

from clausemill.llm import langid
from clausemill.llm.common import text_blocks
from clausemill.llm.queries import op3_language_bitmask


@pytest.fixture(scope="module")
def filters(spark):
    return langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 3 > 0"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = op3_language_bitmask(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.97 * len(found) and len(found) > 150
    assert all(0 <= r.score <= 1 for r in found)


def test_edges(spark, filters):
    texts = [None, "", "123 !?", "你好", "a", "the " * 30_000, "ß"]
    df = spark.createDataFrame([(i, t, "xx", 1) for i, t in enumerate(texts)] + [(None, "the house of the king", None, 2)], "doc_id long, text string, lang_pred string, letters int")
    found = {r.doc_id: r for r in langid.predict(df, filters).collect()}
    assert [found[i].lang_pred for i in range(3)] == ["und"] * 3
    assert found[3].lang_pred in filters.languages and found[3].score == 0
    assert found[5].lang_pred == found[None].lang_pred == "en"
    assert langid.predict(df.limit(0), filters).count() == 0
    kept = langid.keep_identified(df, filters, 0.2)
    assert kept.columns == df.columns
    assert {None, 5} <= {r.doc_id for r in kept.collect()} <= {None, 4, 5, 6}


def test_nothing_learnt(spark):
    none = langid.fit(spark.createDataFrame([(1, None, "en"), (2, "x", None)], "doc_id long, text string, lang string"))
    assert none.languages == []
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in langid.predict(df, none).collect()] == [("und", 0.0)]


def brute_grams(text):
    folded = bytes(b if b >= 0x80 else b | 0x20 if chr(b).isalpha() else 0x20 for b in text.encode())
    framed = b" " + folded + b"   "
    return [g for g in (framed[i : i + 4] for i in range(len(folded) + 1)) if g != b"    "]


def test_grams_and_scores_against_brute_force(filters):
    texts = ["Le chat, c'est 3 éléphants!", "", "x", "the quick brown fox", "  \n"]
    (_, _, data, offsets) = next(text_blocks(pa.array(texts)))
    count, n = langid.scores(filters, data, offsets)
    g, at = langid.grams(data, offsets)
    for i in range(len(filters.languages)):
        bit = lambda s, i=i: int(filters.table[i // 63][s]) >> (i % 63) & 1
        chance = filters.fills[i] ** langid.PROBES
        for k in range(len(texts)):
            own = [x for x in g[at[k] : at[k + 1]] if x != langid._NOTHING]
            assert [int(x).to_bytes(4, "little") for x in own] == brute_grams(texts[k]) and n[k] == len(own)
            places = [[int(s[0]) for s in langid.slots(np.array([x], np.uint32))] for x in own]
            ones = sum(all(bit(s) for s in p) for p in places)
            assert count[k, i] == pytest.approx(max(0, ones - n[k] * chance) / (1 - chance))
