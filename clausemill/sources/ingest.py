"""Sources of uploaded files: clause CSVs, JSON chunks, table CSVs, page texts.

Readers give the file's rows; the functions over rows do the rest, so they work on any DataFrame of such columns. A
quoted field may hold line breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausemill.functions import structure as st

BODY = ["full_clause_text", "text", "raw_text", "content", "body_full", "body"]
NUMBER = ["clause_number", "unit_label", "ncc_anchor", "anchor_id"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header, all columns strings; file, and ord: the row's place in its file, from 0. A file is
    read by one task, as its quoted fields may hold line breaks, so rows are numbered in their order."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    placed = rows.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"))
    return placed.withColumn("ord", F.row_number().over(Window.partitionBy("file").orderBy("ord")).cast("long") - 1)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON files that hold an array of chunks; chunk_index is the place in it."""
    text = spark.read.text(path, wholetext=True)
    chunk = "array<struct<text:string,clause_number:string,page_number:int,metadata:map<string,string>>>"
    return text.select(F.posexplode(F.from_json("value", chunk)).alias("chunk_index", "c")).select("chunk_index", F.coalesce("c.text", F.lit("")).alias("text"), "c.clause_number", "c.page_number", "c.metadata")


def _first(df: DataFrame, names: list[str]) -> Column:
    """The first of the columns that are there and aren't blank."""
    there = [F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there, F.lit(""))


def _listed(title: str, column: Column) -> Column:
    """NOTES and EXCEPTIONS: a JSON array, or one text."""
    items = F.filter(F.coalesce(F.from_json(column, "array<string>"), F.array(column)), lambda x: F.coalesce(x, F.lit("")) != "")
    text = F.concat(F.lit(f"\n\n{title}:\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))
    return F.when(column.isNull() | (F.size(items) == 0), "").otherwise(text)


def clause_rows(rows: DataFrame, codebook: str | None = None) -> DataFrame:
    """chunk_index, text, clause_number, heading, page_number, record_id of rows(ord, ...), and their file if they have it.
    Rows with neither text nor number go; chunk_index is the row's place in its file all the same."""
    rich = "body" in rows.columns or "body_full" in rows.columns
    body = F.coalesce(F.nullif(_first(rows, ["body_full", "body"]), F.lit("")), _first(rows, BODY)) if rich else _first(rows, BODY)
    extra = [_listed(n.upper(), F.col(n)) for n in ("notes", "exceptions") if rich and n in rows.columns]
    number = _first(rows, NUMBER)
    page = st.first_page(_first(rows, ["page_number", "page"]))
    file = ["file"] if "file" in rows.columns else []
    out = rows.select(*file, F.col("ord").alias("chunk_index"), F.concat(body, *extra).alias("text"), number.alias("clause_number"), _first(rows, ["heading", "title"]).alias("heading"), page.alias("page_number"))
    out = out.withColumn("record_id", st.record_id(F.lit(codebook or ""), F.col("clause_number")) if codebook else F.lit(None).cast("string"))
    return out.where((F.trim("text") != "") | (F.col("clause_number") != ""))


def table_rows(rows: DataFrame) -> DataFrame:
    """table_number, title, text, source_clause_number, and the file if rows have it: tables of one canonical number in a
    file become one. Texts that differ from the one before are appended; the longest title stays; clause references are
    joined."""
    file = ["file"] if "file" in rows.columns else []
    source = F.regexp_replace(_first(rows, ["source_clause_number", "clause_reference"]), r"(?i)^clause\s+", "")
    t = rows.select(*file, "ord", _first(rows, ["table_number", "table_id", "table_label"]).alias("number"), _first(rows, ["title", "table_title"]).alias("title"), _first(rows, ["text", "table_content", "table_text"]).alias("text"), F.trim(source).alias("source"))
    t = t.where("number <> '' AND text <> ''").withColumn("canon", st.canonical_table(F.col("number")))
    w = Window.partitionBy(*file, "canon").orderBy("ord")
    t = t.withColumn("fresh", ~F.coalesce(F.col("text").eqNullSafe(F.lag("text").over(w)), F.lit(False)))
    kept = lambda value: F.transform(F.array_sort(F.collect_list(value)), lambda s: s["x"])
    return t.groupBy(*file, "canon").agg(
        F.max_by("title", F.struct(F.length("title"), -F.col("ord"))).alias("title"),
        F.array_join(kept(F.when(F.col("fresh"), F.struct("ord", F.col("text").alias("x")))), "\n\n").alias("text"),
        F.array_join(F.array_distinct(kept(F.when(F.col("source") != "", F.struct("ord", F.col("source").alias("x"))))), "; ").alias("source_clause_number"),
    ).withColumnRenamed("canon", "table_number")


def listing(spark: SparkSession, path: str, depth: int = 6) -> DataFrame:
    """path, size, modified of the files below a folder, at most depth folders down; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    # the root as Spark writes it: what is behind it counts, whatever folders below are called
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    levels = F.size(F.split(F.substr("path", F.lit(len(root) + 1)), "/")) - 1
    return files.where(levels <= depth)


# -- splitting of long documents ----------------------------------------------------------------------

CHUNK_PAGES, WHOLE_PAGES = 93, 100
COST, SECONDS = 0.056, 12.0


def splits(documents: DataFrame) -> DataFrame:
    """document_id, chunk_index, page_start, page_end, page_count for documents(document_id, pages)."""
    n = F.when(F.col("pages") > WHOLE_PAGES, F.ceil(F.col("pages") / CHUNK_PAGES)).otherwise(1)
    size = F.when(F.col("pages") > WHOLE_PAGES, CHUNK_PAGES).otherwise(F.col("pages"))
    each = documents.select("document_id", "pages", size.alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * F.col("size") + 1
    end = F.least(F.col("pages"), (F.col("chunk_index") + 1) * F.col("size"))
    return each.select("document_id", "chunk_index", start.cast("long").alias("page_start"), end.cast("long").alias("page_end"), (end - start + 1).cast("long").alias("page_count"))


def split_estimate(documents: DataFrame) -> DataFrame:
    n = F.when(F.col("pages") > WHOLE_PAGES, F.ceil(F.col("pages") / CHUNK_PAGES)).otherwise(1).cast("long")
    return documents.select("document_id", n.alias("chunks"), F.round(n * COST, 3).alias("cost"), F.round(n * SECONDS, 1).alias("seconds"))


def merged_chunks(parts: DataFrame) -> DataFrame:
    """document_id, page of each found thing in the whole document, for parts(document_id, page_start, page)."""
    return parts.select("document_id", (F.col("page") + F.col("page_start") - 1).alias("page"))
