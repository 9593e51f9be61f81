"""Clauses and tables from lines, blocks and boxes.

Everything orders inside a document (or a page), so windows and groups are as large as one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions import structure as st

#: Lines a clause's body may go on for, and lines of an estimated page.
BODY_LINES, PAGE_LINES = 800, 50


def segments(lines: DataFrame) -> DataFrame:
    """document_id, segment, number, title, first_line, body for lines(document_id, id, line, family): a clause goes from
    its header to the next; rows of tables don't belong to its body. Lines before the first header are left out."""
    by = Window.partitionBy("document_id").orderBy("id")
    t = lines.withColumns({"i": F.row_number().over(by) - 1, "h": st.header(F.col("line"), F.col("family"))})
    t = t.withColumn("segment", F.sum(F.when(F.col("h").isNull(), 0).otherwise(1)).over(by)).where("segment > 0")
    t = t.withColumn("first", F.min("i").over(Window.partitionBy("document_id", "segment")))
    body = (F.col("i") > F.col("first")) & (F.col("i") - F.col("first") < BODY_LINES) & (F.trim("line") != "") & ~st.grid_line(F.col("line"))
    found = F.array_sort(F.collect_list(F.when(body, F.struct("i", F.trim("line").alias("line")))))
    return t.groupBy("document_id", "segment").agg(
        F.max("h.number").alias("number"), F.max("h.title").alias("title"), F.min("first").cast("long").alias("first_line"), F.array_join(F.transform(found, lambda x: x["line"]), " ").alias("body")
    )


def blocks(clauses: DataFrame) -> DataFrame:
    """document_id, segment, block: each clause in the block format of a normalized document."""
    level, parent = st.level_and_parent(F.col("number"), F.lit("AS_NZS"))
    page = (F.floor(F.col("first_line") / PAGE_LINES) + 1).cast("string")
    above = F.when(parent.isNull(), "").otherwise(F.concat(F.lit("Parent: "), parent, F.lit("\n")))
    text = F.concat(F.lit("[CLAUSE]\nNumber: "), "number", F.lit("\nTitle: "), "title", F.lit("\n"), above, F.lit("Level: "), level.cast("string"), F.lit("\nPages: "), page, F.lit("-"), page, F.lit("\nConfidence: high\n\nBody:\n"), "body")
    return clauses.select("document_id", "segment", text.alias("block"))


def parsed_blocks(texts: DataFrame) -> DataFrame:
    """document_id, id, number, title, level, pages, body of each block in texts(document_id, text, ids)."""
    each = texts.select("document_id", "ids", F.posexplode(F.slice(F.split("text", r"\[CLAUSE\]\n"), 2, 1_000_000)).alias("i", "b"))
    field = lambda p: F.regexp_extract("b", p, 1)
    return each.select(
        "document_id",
        F.get("ids", F.col("i")).alias("id"),
        F.trim(field(r"Number:\s*([^\n]+)")).alias("number"),
        F.trim(field(r"Title:\s*([^\n]*)")).alias("title"),
        field(r"Level:\s*([^\n]+)").alias("level"),
        field(r"Pages:\s*([^\n]+)").alias("pages"),
        F.trim(field(r"Body:\s*([^\n]*)")).alias("body"),
    )


def list_items(parts: DataFrame) -> DataFrame:
    """document_id, ord, number, items for parts(document_id, ord, number, body): list items go to the clause before
    them; those behind a document's last clause are dropped."""
    by = Window.partitionBy("document_id")
    t = parts.withColumn("item", st.is_list_item(F.col("number")))
    clause = F.when(~F.col("item"), F.col("ord"))
    t = t.withColumns({"owner": F.max(clause).over(by.orderBy("ord")), "last": F.max(clause).over(by)}).where("owner IS NOT NULL")
    kept = F.when(F.col("item") & (F.col("owner") < F.col("last")), F.struct("ord", F.concat_ws(". ", "number", "body").alias("x")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["x"]), "\n")
    return t.groupBy("document_id", F.col("owner").alias("o")).agg(F.max(F.when(~F.col("item"), F.col("number"))).alias("number"), text.alias("items")).withColumnRenamed("o", "ord")


def with_parents(clauses: DataFrame, parent: Column) -> DataFrame:
    """clauses(document_id, ord, number, ...) with parent_ord; of clauses with one number the last counts."""
    last = clauses.groupBy(F.col("document_id").alias("d"), F.col("number").alias("n")).agg(F.max("ord").alias("parent_ord"))
    return clauses.withColumn("above", parent).join(last, (F.col("document_id") == F.col("d")) & (F.col("above") == F.col("n")), "left").drop("d", "n", "above")


def carried(blocks: DataFrame) -> DataFrame:
    """id, clause, caption of each table in blocks(id, document_id, is_table, number, caption): the last clause before it
    and the last caption since the table before."""
    by = Window.partitionBy("document_id").orderBy("id")
    island = F.coalesce(F.sum(F.col("is_table").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = blocks.withColumn("island", island).withColumns(
        {"clause": F.last("number", ignorenulls=True).over(by), "held": F.last("caption", ignorenulls=True).over(Window.partitionBy("document_id", "island").orderBy("id"))}
    )
    return t.where("is_table").select("id", "clause", F.col("held").alias("caption"))


def evidence_block(is_table: Column, number: Column, title: Column, page: Column, body: Column) -> Column:
    kind = F.when(is_table, "[TABLE ").otherwise("[CLAUSE ")
    return F.concat(kind, number, F.lit("] "), title, F.when(page.isNull(), "").otherwise(F.concat(F.lit(" (page "), page, F.lit(")"))), F.lit("\n"), body)


def quality(tables: DataFrame, garbled: Callable[[Column], Column] = st.garbled) -> DataFrame:
    """tables(table_number, h, d) with reason: why a table isn't one, or null."""
    rows, number = F.concat("h", "d"), F.col("table_number")
    reason = (
        F.when(F.size("d") == 0, "empty")
        .when((F.size(F.get("d", F.lit(0))) <= 2) & ((number == "") | number.startswith("MODAL_P")), "narrow")
        .when(st.density(rows) < 0.1, "low_density")
        .when(garbled(rows), "garbled")
        .when(st.duplicate_columns(F.col("d")), "duplicate_columns")
    )
    return tables.withColumn("reason", reason)


def dropped(tables: DataFrame) -> DataFrame:
    blob = F.array_join(F.concat(F.flatten("h"), F.flatten("d")), " ")
    reason = (
        F.when(F.size("d") == 0, "no_data_rows")
        .when(blob.rlike(st.edged(r"(?i)\bfigure\s+[0-9]")), "figure_not_table")
        .when(blob.rlike(st.edged(r"(?i)\bbibliography\b")), "bibliography")
        .when(blob.rlike(st.edged(r"(?i)\bdesigner.s statement\b")), "form_not_table")
        .when(F.col("table_number").startswith("MODAL_P"), "fallback_id_no_real_table")
        .when(st.glossary(F.flatten("d")), "glossary_not_table")
    )
    return tables.withColumn("reason", reason)


def merged_tables(tables: DataFrame) -> DataFrame:
    """document_id, canon, n, title, first: tables of one canonical number become one; the longest title stays."""
    t = tables.where("table_number <> '' AND text <> ''").select("document_id", st.canonical_table(F.col("table_number")).alias("canon"), F.trim(F.coalesce("title", F.lit(""))).alias("title"), "id")
    return t.groupBy("document_id", "canon").agg(F.count("*").alias("n"), F.max_by("title", F.struct(F.length("title"), -F.col("id"))).alias("title"), F.min("id").alias("first"))


def islands(tables: DataFrame) -> DataFrame:
    """tables with canon and island: a table goes on where the one before it has its number and ends on its page or
    the page before."""
    w = Window.partitionBy("document_id").orderBy("page_start", "y0", "id")
    t = tables.withColumn("canon", st.table_id(F.col("table_number")))
    gap = F.col("page_start") - F.lag("page_end").over(w)
    goes_on = (F.col("canon") == F.lag("canon").over(w)) & gap.between(0, 1) & (F.col("canon") != "Unknown")
    return t.withColumn("fresh", F.when(goes_on, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(w))


def last_by_number(clauses: DataFrame) -> DataFrame:
    """document_id, clause_number, ord: of clauses that share a number, the last of the document."""
    return clauses.where(F.coalesce("clause_number", F.lit("")) != "").groupBy("document_id", "clause_number").agg(F.max("ord").alias("ord"))


def clause_of_table(tables: DataFrame, clauses: DataFrame) -> DataFrame:
    """id, ord of the clause of its document that a table belongs to: by its number, by the parents that the number
    names, by the number's heads; else the deepest clause on its page, the page before or the one behind.

    Numbers become keys and clauses a row for each page they stand on, so that all steps are joins by document and key.
    """
    raw, number = F.col("table_number"), F.coalesce("table_number", F.lit(""))
    parts = F.split(F.regexp_replace(raw, "Table ", ""), r"\.")
    heads = F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    named = tables.where((number != "") & ~number.startswith("MODAL_P"))
    keys = named.select("document_id", "id", F.posexplode(F.concat(F.array(raw), st.candidate_parents(raw), heads)).alias("priority", "clause_number"))
    by_number = keys.join(last_by_number(clauses), ["document_id", "clause_number"]).groupBy("document_id", "id").agg(F.min_by("ord", "priority").alias("by_number"))
    # the deepest clause of each page, the first of several
    pages = clauses.where("page_end >= page_start").select("document_id", "ord", "level", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    deepest = pages.groupBy("document_id", "page").agg(F.max_by("ord", F.struct("level", -F.col("ord"))).alias("on_page"))
    near = tables.select("document_id", "id", F.posexplode(F.array(F.col("page_start"), F.col("page_start") - 1, F.col("page_start") + 1)).alias("step", "page"))
    by_page = near.join(deepest, ["document_id", "page"]).groupBy("document_id", "id").agg(F.min_by("on_page", "step").alias("by_page"))
    found = tables.select("document_id", "id").join(by_number, ["document_id", "id"], "left").join(by_page, ["document_id", "id"], "left")
    return found.select("document_id", "id", F.coalesce("by_number", "by_page").alias("ord"))


def referenced_clause(tables: DataFrame, clauses: DataFrame) -> DataFrame:
    """id, ord: the clause of the table's document with its number, else the first that mentions the table, else its
    section's. Mentions are read from the clauses once and joined by number, so no clause meets every table."""
    last = last_by_number(clauses)
    mentions = F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?:Table|table|TABLE) ([A-Z]?[0-9]+(?:\.[0-9]+)*)"), F.lit(1)))
    mentioned = clauses.select("document_id", "ord", F.explode(mentions).alias("canon")).groupBy("document_id", "canon").agg(F.min("ord").alias("by_mention"))
    t = tables.select("document_id", "id", st.table_id(F.col("table_number")).alias("canon")).withColumn("section", F.regexp_extract("canon", "^([A-Z]?[0-9]+)", 1))
    own = lambda key, name: last.select("document_id", F.col("clause_number").alias(key), F.col("ord").alias(name))
    t = t.join(own("canon", "own"), ["document_id", "canon"], "left").join(mentioned, ["document_id", "canon"], "left").join(own("section", "of_section"), ["document_id", "section"], "left")
    return t.select("document_id", "id", F.coalesce("own", "by_mention", "of_section").alias("ord"))


def _pairs(boxes: DataFrame, *conditions: str) -> DataFrame:
    """Tables t and elements e of one page that the conditions hold for."""
    t, e = boxes.where("kind = 'table'").alias("t"), boxes.where("kind = 'element'").alias("e")
    return t.join(e, (F.col("t.page") == F.col("e.page")) & F.expr(" AND ".join(conditions)))


def region_text(boxes: DataFrame) -> DataFrame:
    """id, n, text of the elements that overlap a table, from top to bottom."""
    p = _pairs(boxes, "e.x0 < t.x1", "e.x1 > t.x0", "e.y0 < t.y1", "e.y1 > t.y0")
    found = F.array_sort(F.collect_list(F.struct("e.y0", "e.x0", "e.id", "e.text")))
    return p.groupBy("t.id").agg(F.count("*").alias("n"), F.array_join(F.transform(found, lambda x: x["text"]), " ").alias("text"))


def centred(boxes: DataFrame) -> DataFrame:
    """cell, element: elements whose centre lies in a cell."""
    p = _pairs(boxes, "(e.x0 + e.x1) / 2 BETWEEN t.x0 AND t.x1", "(e.y0 + e.y1) / 2 BETWEEN t.y0 AND t.y1")
    return p.select(F.col("t.id").alias("cell"), F.col("e.id").alias("element"))


def captions(boxes: DataFrame, above: int = 200, beside: int = 50) -> DataFrame:
    """id, caption: the closest caption above a table."""
    p = _pairs(boxes, "startswith(e.text, 'Table ')", f"e.y1 BETWEEN t.y0 - {above} AND t.y0", f"e.x0 < t.x1 + {beside}", f"e.x1 > t.x0 - {beside}")
    return p.groupBy("t.id").agg(F.min_by("e.id", F.struct(F.col("t.y0") - F.col("e.y1"), "e.id")).alias("caption"))
