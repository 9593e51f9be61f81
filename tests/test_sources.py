"""Files in and out."""

import json

from pyspark.sql import functions as F

from clausemill.sources import ingest, sinks


def test_clause_csv_with_notes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "clauses.csv"
    path.write_text('﻿clause_number,body,notes,exceptions,heading,page\n1.1,"a\nb","[""n1"", """"]",not json,Scope,12-14\n,,,,,\n2,,,,,x\n', encoding="utf-8")
    rows = ingest.clause_rows(ingest.read_csv(spark, str(path)), "ncc 2022").orderBy("chunk_index").collect()
    assert [(r.text, r.clause_number, r.heading, r.page_number, r.record_id) for r in rows] == [
        ("a\nb\n\nNOTES:\n- n1\n\nEXCEPTIONS:\n- not json", "1.1", "Scope", 12, "NCC_2022:1.1"),
        ("", "2", "", None, "NCC_2022:2"),
    ]


def test_json_chunks_keep_their_places(spark, tmp_path):
    path = tmp_path / "chunks.json"
    path.write_text(json.dumps([{"text": "a", "clause_number": "1"}, {"clause_number": "2", "page_number": 7}]))
    assert [(r.chunk_index, r.text, r.clause_number, r.page_number) for r in ingest.read_json(spark, str(path)).orderBy("chunk_index").collect()] == [(0, "a", "1", None), (1, "", "2", 7)]


def test_tables_of_one_number_merge(spark, tmp_path):
    path = tmp_path / "tables.csv"
    path.write_text("table_number,title,text,clause_reference\n4.3,Short,one,Clause 4\nTable 4.3,Longer title,two,5\nTABLE 4.3,x,two,4\n,no number,z,\n9,t,,\n")
    rows = ingest.table_rows(ingest.read_csv(spark, str(path))).collect()
    assert [tuple(r)[1:] for r in rows] == [("Table 4.3", "Longer title", "one\n\ntwo", "4; 5")]


def test_rows_of_several_files_count_from_their_own_start(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("table_number,title,text\n" + "".join(f"4.{i},{name},{name} {i}\n" for i in range(3)) + f"4.0,longer {name},again\n")
    rows = ingest.read_csv(spark, str(tmp_path))
    assert sorted((r.file[-5:], r.ord, r.text) for r in rows.collect()) == sorted((f"{n}.csv", i, t) for n in "ab" for i, t in enumerate([f"{n} 0", f"{n} 1", f"{n} 2", "again"]))
    chunks = ingest.clause_rows(rows.withColumnRenamed("table_number", "clause_number"))
    assert sorted((r.file[-5:], r.chunk_index) for r in chunks.collect()) == [(f"{n}.csv", i) for n in "ab" for i in range(4)]
    tables = ingest.table_rows(rows)
    assert sorted((r.file[-5:], r.table_number, r.title, r.text) for r in tables.collect()) == sorted((f"{n}.csv", f"Table 4.{i}", f"longer {n}" if i == 0 else n, f"{n} 0\n\nagain" if i == 0 else f"{n} {i}") for n in "ab" for i in range(3))


def test_listing_is_as_deep_as_asked(spark, tmp_path):
    tmp_path = tmp_path / "root"
    for p in ("a.txt", "x/b.txt", "x/y/c.txt", "x/root/d.txt", "x/root/root/e.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("12345")
    found = ingest.listing(spark, str(tmp_path), depth=1).collect()
    assert sorted(r.path.rsplit("/", 1)[-1] for r in found) == ["a.txt", "b.txt"] and {r.size for r in found} == {5}


def test_splits_cover_all_pages(spark):
    df = spark.createDataFrame([(1, 100), (2, 101), (3, 650)], "document_id long, pages long")
    rows = ingest.splits(df).orderBy("document_id", "chunk_index").collect()
    assert [(r.page_start, r.page_end) for r in rows if r.document_id == 2] == [(1, 93), (94, 101)]
    assert {d: sum(r.page_count for r in rows if r.document_id == d) for d in (1, 2, 3)} == {1: 100, 2: 101, 3: 650}


def test_written_files_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "a", b', None), (2, "line\nbreak", "x")], "id int, title string, note string")
    sinks.write_tables_csv(df, str(tmp_path / "t"))
    back = spark.read.csv(str(tmp_path / "t"), header=True, multiLine=True, escape="\\").orderBy("id").collect()
    assert [r.title for r in back] == ['say "a", b', "line\nbreak"]
    sinks.write_clauses_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True).count() == 2
    assert [json.loads(r.value) for r in sinks.json_rows(df.orderBy("id")).collect()] == [{"id": 1, "title": 'say "a", b'}, {"id": 2, "title": "line\nbreak", "note": "x"}]
    sinks.write_chunks(df.withColumn("codebook", F.lit("AS")), str(tmp_path / "k"))
    assert (tmp_path / "k" / "codebook=AS").is_dir()
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    assert sorted(map(tuple, sinks.upserted(old, spark.createDataFrame([(2, "c"), (3, "d")], "id int, x string"), ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert spark.range(1).select(sinks.yaml_text(F.lit("t"), {"a": F.lit('q"'), "b": F.lit(None).cast("string")}).alias("y")).first().y == '# t\na: "q\\""'
