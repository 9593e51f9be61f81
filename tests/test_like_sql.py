"""Queries against their SQL over hand-made rows that the test tables hardly have."""

import pytest
from pyspark.sql import functions as F
from twins import differences

from clausemill.operators import reports
from clausemill.plans import catalog


def documents(spark, folder, texts):
    rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["C32_jurisdiction", "C7_caption_id", "C14_clean_text", "C27_description_check", "C35_caption_title", "F17_false_region", "F26_degraded_rows"])
def test_words_beside_letters_beyond_ascii(spark, tmp_path, name):
    words = ["ÉNT! rest", "ACTé and", "éSA Table", "çTable 3.1 é", "Tableé 3.1", "Table 3.1é", "COPYRIGHTé", "éspecifies", "éfigure", "éUnknown Unknown"]
    d = documents(spark, tmp_path, [w for w in words for _ in range(9)])
    assert differences(spark, d, catalog.QUERIES[name], catalog.SQL[name]) == ""


@pytest.mark.parametrize("name", ["F13_garbled", "F11_quality_filters"])
def test_tables_with_odd_letters(spark, tmp_path, name):
    texts = ["daa daa daa daa daa", "• •• •• •• ••", "COPYRIGHT a b c d", "a b COPYRIGHT c d", "plain words of a text"]
    d = documents(spark, tmp_path, [t for t in texts for _ in range(14)])
    assert differences(spark, d, catalog.QUERIES[name], catalog.SQL[name]) == ""


def test_scope_of_many_requirements(spark):
    docs = spark.range(9000).selectExpr("id AS document_id", "concat('src', id % 3) AS codebook")
    wants = spark.createDataFrame([(1, ["SRC 1", "src-1", "x"]), (2, []), (3, ["gone"]), (4, ["src0", "src2"]), (5, None)], "id long, sources array<string>")
    found = {r.id: r["count"] for r in reports.routed(wants, docs).groupBy("id").count().collect()}
    assert found == {1: 3000, 2: 9000, 4: 6000}
    many = wants.crossJoin(spark.range(100_000).withColumnRenamed("id", "copy")).select(F.col("copy").alias("id"), "sources")
    one = reports.scope_estimate(many, docs).first()
    assert (one.requirements, one.calls, one.level) == (500_000, 100_000 * (3000 + 9000 + 1 + 6000 + 1), "block")


def test_pairs_of_one_code_come_from_many_tasks(spark):
    docs = spark.range(50).selectExpr("id AS document_id", "'src1' AS codebook")
    wants = spark.range(2000).select("id", F.array(F.lit("src1")).alias("sources"))
    tasks = {r.t for r in reports.routed(wants, docs).select(F.spark_partition_id().alias("t")).distinct().collect()}
    assert len(tasks) > 16


def test_written_pairs_are_small(spark, tmp_path):
    """Their number is the product of both sides, so a disk holds them only in few bytes each."""
    docs = spark.range(6000).selectExpr("id AS document_id", "concat('src', id % 3) AS codebook")
    wants = spark.range(900).select("id", F.when(F.col("id") % 2 == 0, F.array(F.lit("src1"))).otherwise(F.array().cast("array<string>")).alias("sources"))
    reports.routed(wants, docs).write.parquet(f"{tmp_path}/pairs")
    found = spark.read.parquet(f"{tmp_path}/pairs")
    assert found.count() == found.distinct().count() == 450 * 2000 + 450 * 6000
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * found.count()


def test_pairs_keep_ids_that_are_null(spark):
    docs = spark.createDataFrame([(None, "src1"), (2, None)], "document_id long, codebook string")
    wants = spark.createDataFrame([(None, []), (7, ["src1"])], "id long, sources array<string>")
    assert {tuple(x) for x in reports.routed(wants, docs).collect()} == {(None, None), (None, 2), (7, None)}


def test_a_search_names_documents_or_none(spark):
    from clausemill.plans import function_queries as fq
    from clausemill.sources.derived import Views

    v = Views(spark, "/root/testdata/sf0.001")
    found = lambda ids: sorted(r.chunk_id for r in fq._sql(v, f"SELECT chunk_id FROM search_chunks_heading(3L, {ids}, 'e', p_limit => 500)").collect())
    every = "array(" + ", ".join(f"{r.id}L" for r in v.docs.select("id").collect()) + ")"
    assert found("CAST(NULL AS ARRAY<BIGINT>)") == found(every) != []
    assert found("array(-1L)") == []
