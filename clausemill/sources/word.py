"""Word files as a data source: the blocks of a document's body in their order, and the tables and lines in them.

    spark.dataSource.register(WordSource)
    spark.read.format("word").load("/uploads")            # or a URI: hdfs://..., s3://...

A file is read by one task through a seekable handle; its XML is parsed as a stream, so a task holds one block (a
paragraph or a table) and not the document. Small files share a task.
"""

from __future__ import annotations

import posixpath
import zipfile
import zlib
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from clausemill.functions import structure as st

SCHEMA = "file string, block long, kind string, text string, cells array<array<string>>"
#: A task takes files until they have this many bytes together; option "bytes".
BYTES = 128 << 20

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_P, _R, _LINK, _TBL, _TR, _TC = (_W + x for x in ("p", "r", "hyperlink", "tbl", "tr", "tc"))
_SIGNS = {_W + "tab": "\t", _W + "ptab": "\t", _W + "cr": "\n", _W + "noBreakHyphen": "-"}
_MAIN = "/relationships/officeDocument"


def paragraph_text(p: ElementTree.Element) -> str:
    """The text of a paragraph's runs and links; deleted text and fields' codes aren't in these."""
    parts = []
    for run in (r for child in p if child.tag in (_R, _LINK) for r in ([child] if child.tag == _R else child.findall(_R))):
        for x in run:
            if x.tag == _W + "t":
                parts.append(x.text or "")
            elif x.tag == _W + "br":  # breaks of pages and columns aren't text
                parts.append("\n" if x.get(_W + "type", "textWrapping") == "textWrapping" else "")
            else:
                parts.append(_SIGNS.get(x.tag, ""))
    return "".join(parts)


def _number(x: ElementTree.Element | None) -> int:
    value = "" if x is None else x.get(_W + "val", "")
    return int(value) if value.isdigit() else 0


def table_cells(tbl: ElementTree.Element) -> list[list[str]]:
    """Rows of cells. A cell that spans columns is there once for each, one that spans rows in each of them."""
    rows: list[list[str]] = []
    above: dict[int, list[str]] = {}
    for tr in tbl.findall(_TR):
        at, row, held = _number(tr.find(f"{_W}trPr/{_W}gridBefore")), [], {}
        for tc in tr.findall(_TC):
            span = max(_number(tc.find(f"{_W}tcPr/{_W}gridSpan")), 1)
            merge = tc.find(f"{_W}tcPr/{_W}vMerge")
            if merge is not None and merge.get(_W + "val", "continue") == "continue" and at in above:
                texts = above[at]
            else:
                texts = ["\n".join(paragraph_text(p) for p in tc.findall(_P))] * span
            held[at] = texts
            row += texts
            at += span
        above = held
        rows.append(row)
    return rows


def _body(package: zipfile.ZipFile) -> IO[bytes]:
    """The part that the package names as its document."""
    with package.open("_rels/.rels") as f:
        for x in ElementTree.parse(f).getroot():
            if x.get("Type", "").endswith(_MAIN):
                return package.open(posixpath.normpath(x.get("Target", "")).lstrip("/"))
    raise KeyError("no document in _rels/.rels")


def blocks(source: IO[bytes]) -> Iterator[tuple[int, str, str | None, list[list[str]] | None]]:
    """block, kind, text, cells of each paragraph and table that stands in the body itself, as they follow each other."""
    with zipfile.ZipFile(source) as package, _body(package) as xml:
        path: list[ElementTree.Element] = []
        place = 0
        for event, x in ElementTree.iterparse(xml, ("start", "end")):
            if event == "start":
                path.append(x)
                continue
            path.pop()
            if len(path) != 2 or path[1].tag != _W + "body":
                continue
            if x.tag == _P:
                yield place, "paragraph", paragraph_text(x), None
            elif x.tag == _TBL:
                yield place, "table", None, table_cells(x)
            place += x.tag in (_P, _TBL)
            path[1].clear()


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WordReader(DataSourceReader):
    def __init__(self, root: str, size: int, permissive: bool):
        self.root, self.size, self.permissive = root, size, permissive

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def partitions(self) -> list[Files]:
        """Files in the order of their names, as many to a task as fit in its bytes. Word's lock files (~$) aren't read."""
        store, path = self._open()
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        docs = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(".docx") and not f.base_name.startswith(("~$", ".")))
        tasks: list[Files] = []
        held = 0
        for name, size in docs:
            if not tasks or held + size > self.size:
                tasks.append(Files([]))
                held = 0
            tasks[-1].paths.append(name)
            held += size
        return tasks or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store = self._open()[0]
        for path in partition.paths:
            try:
                with store.open_input_file(path) as f:
                    for block in blocks(f):
                        yield (path, *block)
            except (zipfile.BadZipFile, zlib.error, KeyError, ElementTree.ParseError, pa.ArrowInvalid) as e:  # the last for files too short to be one
                if not self.permissive:
                    raise ValueError(f"{path} isn't a Word file: {e}") from e
                yield path, -1, "unreadable", str(e), None


class WordSource(DataSource):
    """file, block, kind, text, cells of the .docx files at and below a path.

    kind is paragraph (with text, empty ones too) or table (with cells); block counts both from 0 in each file. A file that isn't
    a Word document fails the read, or with option("mode", "PERMISSIVE") is a row of kind unreadable with the reason as its text, behind the
    blocks that could be read. A folder without files has no rows; a path that isn't there is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "word"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WordReader:
        return WordReader(self.options["path"], int(self.options.get("bytes", BYTES)), self.options.get("mode", "FAILFAST").upper() == "PERMISSIVE")


# -- what the blocks say ------------------------------------------------------------------------------


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def one_line(text: Column) -> Column:
    """A cell's or paragraph's text on one line, without symbol-font characters."""
    return _strip(F.regexp_replace(F.translate(st.sanitized(text), "\r\n", "  "), r"[ \t]+", " "))


def word_lines(blocks: DataFrame) -> DataFrame:
    """file, block, text of the paragraphs that aren't blank, for the clause parser."""
    return blocks.where("kind = 'paragraph'").select("file", "block", one_line(F.col("text")).alias("text")).where("text <> ''")


def word_tables(blocks: DataFrame, family: Column) -> DataFrame:
    """file, block, table_id, table_number, title, parent_clause_number, header, data, text, prose of each table with a cell that
    isn't blank.

    A table has the last caption since the table before, else a number made of the last clause before it and its place
    among the file's tables. Rows of blank cells go. Order matters inside a file only; a table's own cells don't move
    through the window's sort more than once.
    """
    # a row's own blank cells stay, as they hold its columns apart
    cells = F.transform("cells", lambda row: F.transform(row, one_line))
    t = blocks.where("kind IN ('paragraph', 'table')").select("file", "block", one_line(F.col("text")).alias("line"), F.filter(cells, lambda row: F.exists(row, lambda c: c != "")).alias("rows"))
    t = t.where((F.col("line") != "") | (F.size("rows") > 0)).withColumn("is_table", F.col("rows").isNotNull())
    caption = F.when(~F.col("is_table"), st.caption_id(F.col("line")))
    t = t.withColumns({"caption": F.when(caption.isNotNull(), F.struct(caption.alias("id"), F.col("line"))), "number": F.when(~F.col("is_table"), st.header(F.col("line"), family)["number"])})
    by = Window.partitionBy("file").orderBy("block")
    t = t.withColumn("before", F.coalesce(F.sum(F.col("is_table").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("clause", F.last("number", ignorenulls=True).over(by))
    t = t.withColumn("held", F.last("caption", ignorenulls=True).over(Window.partitionBy("file", "before").orderBy("block"))).where("is_table")
    place = (F.col("before") + 1).cast("string")
    number = F.coalesce("held.id", F.concat(F.lit("Table "), F.coalesce("clause", F.lit("unnumbered")), F.lit("-"), place))
    title = _strip(F.regexp_replace(F.coalesce("held.line", F.lit("")), r"(?i)^table\s+\S+\s*[-–—:]?\s*", ""))
    header, data = F.get("rows", F.lit(0)), F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(1)))
    width = F.array_max(F.transform("rows", F.size))
    lines = F.transform("rows", lambda r: F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "))
    head = F.regexp_replace(F.concat(number, F.lit(": "), title), "^[: ]+|[: ]+$", "")
    told = F.filter(F.transform(data, lambda r: st.row_prose(header, r)), lambda x: x != "")
    return t.select(
        "file",
        "block",
        F.concat(F.lit("word:"), place, F.lit(":"), number).alias("table_id"),
        number.alias("table_number"),
        F.coalesce(F.nullif(title, F.lit("")), number).alias("title"),
        F.col("clause").alias("parent_clause_number"),
        header.alias("header"),
        data.alias("data"),
        F.array_join(lines, "\n").alias("text"),
        F.array_join(F.concat(F.array(head), told), "\n").alias("prose"),
    )
