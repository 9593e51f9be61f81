"""Word files: made by hand here, read block by block."""

import zipfile

import pytest
from pyspark.sql import functions as F

from clausemill.sources.word import SCHEMA, WordSource, word_lines, word_tables

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="{}"/></Relationships>'


def p(*runs):
    return "<w:p>" + "".join(r if r.startswith("<") else f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


def tc(text, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{''.join(p(t) for t in text.split('#'))}</w:tc>"


def tbl(*rows):
    return "<w:tbl><w:tblPr/>" + "".join(f"<w:tr>{''.join(c if c.startswith('<') else tc(c) for c in r)}</w:tr>" for r in rows) + "</w:tbl>"


def docx(path, *body, part="word/document.xml", target="word/document.xml"):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("_rels/.rels", RELS.format(target))
        z.writestr(part, f"<w:document {NS}><w:body>{''.join(body)}<w:sectPr/></w:body></w:document>")


def read(spark, path, **options):
    spark.dataSource.register(WordSource)
    return spark.read.format("word").options(**options).load(str(path))


def test_blocks_in_order_with_breaks_links_and_merged_cells(spark, tmp_path):
    link = "<w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink>"
    signs = '<w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t><w:br w:type="page"/><w:noBreakHyphen/><w:delText>gone</w:delText></w:r>'
    deleted = "<w:del><w:r><w:t>deleted</w:t></w:r></w:del>"
    span, down, on = '<w:gridSpan w:val="2"/>', '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    grid = tbl([tc("wide", span), tc("tall#two lines", down)], ["x", "y", tc("", on)])
    docx(tmp_path / "a.docx", p("See ", link), p(signs, deleted), p(), grid, "<w:sdt><w:sdtContent>" + p("control") + "</w:sdtContent></w:sdt>", p("end"))
    got = [tuple(r)[1:] for r in read(spark, tmp_path).orderBy("block").collect()]
    tall = "tall\ntwo lines"
    assert got == [
        (0, "paragraph", "See link", None),
        (1, "paragraph", "a\tb\nc-", None),
        (2, "paragraph", "", None),
        (3, "table", None, [["wide", "wide", tall], ["x", "y", tall]]),
        (4, "paragraph", "end", None),
    ]


def test_captions_and_clauses_are_carried_to_tables(spark, tmp_path):
    docx(
        tmp_path / "s.docx",
        tbl(["a", "b"], ["1", "2"]),
        p("4.2 General requirements"),
        p("Table 4.1 - Loads of floors"),
        p("   "),
        tbl(["", ""], [" ", ""]),
        tbl(["Use", "", "kPa"], ["", "", ""], ["Office", "x", "3\n.0"], ["Store"]),
        p(" Text after"),
        tbl(["only a header"]),
    )
    rows = word_tables(read(spark, tmp_path), F.lit("AS_NZS")).orderBy("block").collect()
    assert [(r.table_id, r.table_number, r.title) for r in rows] == [
        ("word:1:Table unnumbered-1", "Table unnumbered-1", "Table unnumbered-1"),
        ("word:2:Table 4.1", "Table 4.1", "Loads of floors"),
        ("word:3:Table 4.2-3", "Table 4.2-3", "Table 4.2-3"),
    ]
    assert [r.parent_clause_number for r in rows] == [None, "4.2", "4.2"]
    assert rows[1].header == ["Use", "", "kPa"] and rows[1].data == [["Office", "x", "3 .0"], ["Store"]]
    assert rows[1].text == "Use |  | kPa\nOffice | x | 3 .0\nStore |  | "
    assert rows[1].prose == "Table 4.1: Loads of floors\nUse: Office; col2: x; kPa: 3 .0\nUse: Store"
    assert rows[2].data == [] and rows[2].prose == "Table 4.2-3"
    assert [r.text for r in word_lines(read(spark, tmp_path)).orderBy("block").collect()] == ["4.2 General requirements", "Table 4.1 - Loads of floors", "Text after"]


def test_files_below_a_folder_keep_their_own_blocks_and_captions(spark, tmp_path):
    (tmp_path / "below").mkdir()
    for i, name in enumerate(["one.docx", "below/two.DOCX", "below/three.docx"]):
        docx(tmp_path / name, p(f"{i + 1}.1 Heading of a file"), tbl([f"t{i}"]), part="main.xml", target="/main.xml")
    docx(tmp_path / "below/~$two.docx", p("lock"))
    (tmp_path / "notes.txt").write_text("not read")
    together, apart = read(spark, tmp_path), read(spark, tmp_path, bytes="1")
    assert (together.rdd.getNumPartitions(), apart.rdd.getNumPartitions()) == (1, 3)
    assert sorted(map(str, together.collect())) == sorted(map(str, apart.collect()))
    assert sorted((r.block, r.parent_clause_number) for r in word_tables(apart, F.lit("AS_NZS")).collect()) == [(1, "1.1"), (1, "2.1"), (1, "3.1")]
    assert read(spark, tmp_path / "one.docx").count() == 2


def test_unreadable_files_are_said_and_empty_folders_are_empty(spark, tmp_path):
    folder = tmp_path / "some"
    folder.mkdir()
    assert read(spark, folder).count() == 0
    (folder / "bad.docx").write_bytes(b"no archive")
    docx(folder / "good.docx", p("x" * 300_000))
    with zipfile.ZipFile(folder / "other.docx", "w") as z:
        z.writestr("_rels/.rels", RELS.format("word/missing.xml"))
    with pytest.raises(Exception, match="isn't a Word file"):
        read(spark, folder).collect()
    got = read(spark, folder, mode="PERMISSIVE")
    assert sorted((r.file.rsplit("/", 1)[1], r.kind, r.block) for r in got.collect()) == [("bad.docx", "unreadable", -1), ("good.docx", "paragraph", 0), ("other.docx", "unreadable", -1)]
    assert word_lines(got).select(F.length("text")).collect()[0][0] == 300_000
    assert word_tables(spark.createDataFrame([], SCHEMA), F.lit("AS_NZS")).count() == 0
