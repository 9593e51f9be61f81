"""R3, R4 and R28 over chunks with large ids, against plain Python."""

from clausemill.functions.similarity import partial_ratio, token_set_ratio
from clausemill.plans import catalog

TEXTS = ["earthing of a conductor", "one two other", "nothing alike", "conduct", "three earth"]


def test_chunks_of_any_id(spark, tmp_path):
    d = str(tmp_path)
    docs = [(5000 + i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "one two three earthing conductor")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    built = {r.id: r.search_text for r in catalog.QUERIES["R28_text_builders"](spark, d).collect()}
    assert sorted(built) == [x[0] for x in docs]
    proxy = {i: max(token_set_ratio(t, c) for t in ("one two three", "earthing", "conductor")) for i, c in built.items()}
    fuzzy = {i: max(partial_ratio(t, c.lower()) for t in ("earthing", "conductor")) for i, c in built.items()}
    for name, scores, least in (("R3_vector_proxy", proxy, 15), ("R4_fuzzy", fuzzy, 40)):
        want = sorted((i for i in scores if scores[i] > least), key=lambda i: (-round(scores[i], 9), i))
        assert want and [r.chunk_id for r in sorted(catalog.QUERIES[name](spark, d).collect(), key=lambda r: r["rank"])] == want
