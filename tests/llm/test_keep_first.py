from clausemill.llm import chunk_recipes


def test_repeated_and_null_ids_keep_one_row(spark):
    rows = [(4, "a  b"), (4, "a b"), (4, "a b"), (9, "a b"), (None, "c"), (None, "c"), (None, "d"), (4, "e"), (None, "e"), (5, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = chunk_recipes.keep_first(df)
    assert found.columns == df.columns
    assert sorted((r.doc_id or 0, " ".join((r.text or "").split())) for r in found.collect()) == [(0, "c"), (0, "d"), (4, "a b"), (4, "e"), (5, "")]
