"""Retrieval queries over texts whose matches lie behind the 200th character."""

import re

from clausemill.functions.text import trigrams
from clausemill.plans import catalog

FILL = "zz " * 80


def grams(text):
    return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for i in range(len(w) + 1)}


def folder(spark, tmp_path, texts):
    d = str(tmp_path)
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "one two three earthing conductor")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(3)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


def test_trigrams_of_2000_characters(spark, tmp_path):
    texts = [FILL + "earthing", FILL + "conductor", "zz " * 700 + "earthing", FILL]
    d = folder(spark, tmp_path, texts)
    want = set()
    for i, t in enumerate(texts):
        for pos, term in enumerate(["earthing", "conductor"]):
            a, b = grams(t[:2000]), grams(term)
            if len(a & b) / len(a | b) >= 0.3:
                want.add((1, pos, i))
    assert {(r.query_id, r.term_pos, r.chunk_id) for r in catalog.QUERIES["R8_trigram"](spark, d).collect()} == want == {(1, 0, 0), (1, 1, 1)}
    assert {r.chunk_id for r in catalog.QUERIES["A26_best_over_terms"](spark, d).collect()} == {0, 1}
    assert [r.n for r in catalog.QUERIES["U8_best_score"](spark, d).collect()] == [2]


def found_by_postings(spark, d):
    return {(r.query_id, r.term_pos, r.chunk_id) for r in catalog.QUERIES["R8_by_postings"](spark, d).collect()}


def test_postings_have_trigrams_of_whole_texts(spark, tmp_path):
    d = folder(spark, tmp_path, ["zz " * 700 + "earthing", "zz " * 7000 + "conductor", FILL])
    assert found_by_postings(spark, d) == {(1, 0, 0), (1, 1, 1)}


def test_postings_are_those_of_the_rows_that_are_there(spark, tmp_path):
    """Rows that come into a table after the session's index of it was built are searched too."""
    d = folder(spark, tmp_path, [FILL + "earthing", FILL])
    assert found_by_postings(spark, d) == {(1, 0, 0)}
    more = spark.createDataFrame([(2, FILL + "conductor", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    more.write.mode("append").parquet(f"{d}/documents.parquet")
    assert found_by_postings(spark, d) == {(1, 0, 0), (1, 1, 2)}


def test_trigrams_of_long_words(spark):
    words = ["a" * 63 + "b", "\U00010400" + "xyz" * 21, "ab\U00010428" * 30, "c" * 62, "ab ab cd"]
    rows = spark.createDataFrame([(w,) for w in words], "text string").select("text", trigrams("text").alias("grams")).collect()
    assert all(len(r.grams) == len(set(r.grams)) and set(r.grams) == grams(r.text) for r in rows)


def test_clause_number_in_the_whole_text_only(spark, tmp_path):
    d = folder(spark, tmp_path, [FILL + "see 2.4.3", "no number", FILL])
    found = {(r.query_id, r.id) for r in catalog.QUERIES["R14_clause_number_search"](spark, d).collect()}
    assert found == {(3, 0)}
