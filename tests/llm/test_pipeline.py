"""The pipeline stage by stage against plain Python over what the stage before kept."""

import os
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from clausemill.llm import langid
from clausemill.llm.common import fold_remainder

sys.path.insert(0, os.path.dirname(__file__))
import test_chunk_recipes
import test_credentials
import test_near_copies
import test_packing

SMALL = "/root/testdata/sf0.01"


def masked(text):
    new, at = "", 0
    for s, e in sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in test_credentials.brute(text)[4].split(",") if x)):
        new, at = (new + text[at:s] + "[SECRET]", e) if s >= at else (new, max(at, e))
    return new + text[at:]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns
            kept.append({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    everything = spark.read.parquet(f"{SMALL}/documents.parquet")
    scored = langid.predict(everything, langid.fit(everything.where(fold_remainder(F.col("doc_id"), 4) != 2))).collect()
    assert set(kept[0]) == {r.doc_id for r in scored if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    assert set(kept[1]) == {x[1] for x in test_chunk_recipes.brute(list(kept[0].items()))}
    before_near = list(kept[1].items())
    assert set(kept[2]) == test_near_copies.firsts([i for i, _ in before_near], test_near_copies.near_pairs(before_near))
    assert kept[3] == {i: masked(t) for i, t in kept[2].items()}
    assert kept[3] != kept[2] and len(kept[2]) < len(kept[0])
    test_packing.check(list(kept[3].items()), docs.collect())
    assert {r.doc_id for r in before.collect()} == set(kept[3])
