"""The fixed columns of the files that clauses and tables are exported to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions import structure as st

#: The columns of both files, in their order.
CLAUSE_COLUMNS = ["id", "clause_number", "heading", "body", "notes", "exceptions", "level", "parent_number", "parent_id", "page", "confidence", "appendix_flag", "embeddable", "is_heading_only", "had_duplicate_merge", "source_rows", "codebook"]
TABLE_COLUMNS = ["volume", "part_code", "section_code", "table_id", "unit_type", "table_title", "table_content", "content_part", "content_parts_total", "called_in", "clause_reference", "source", "context", "clause_count", "first_clause_id", "last_clause_id", "archived", "state_territory", "source_file", "version"]
#: Characters that a body has at least if its clause isn't a heading only.
LEAST_BODY = 10


def _text(c: str) -> Column:
    return F.coalesce(c, F.lit(""))


def codebook_id(label: str) -> Column:
    return F.split(st.record_id(F.lit(label), F.lit("x")), ":")[0]


def clauses(rows: DataFrame, codebook: str) -> DataFrame:
    """CLAUSE_COLUMNS of rows(clause_number, title, body, notes array, exceptions array, level, page_start, page_end,
    confidence, has_body)."""
    number, body = _text("clause_number"), _text("body")
    parts = F.split(number, r"\.")
    parent = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ".")
    pages = F.when(F.col("page_start") == F.col("page_end"), F.col("page_start").cast("string")).otherwise(F.concat_ws("-", F.col("page_start").cast("string"), F.col("page_end").cast("string")))
    known = (F.coalesce("page_start", F.lit(0)) != 0) & (F.coalesce("page_end", F.lit(0)) != 0)
    lines = lambda c: F.coalesce(F.array_join(c, "\n"), F.lit(""))
    values = {
        "id": st.record_id(F.lit(codebook), number),
        "clause_number": number,
        "heading": _text("title"),
        "body": body,
        "notes": lines("notes"),
        "exceptions": lines("exceptions"),
        "level": F.col("level"),
        "parent_number": parent,
        "parent_id": st.record_id(F.lit(codebook), parent),
        "page": F.when(known, pages).otherwise(""),
        "confidence": F.col("confidence"),
        "appendix_flag": F.lit(False),
        "embeddable": F.lit(True),
        "is_heading_only": ~F.coalesce("has_body", F.lit(False)) | (F.length(F.trim(body)) < LEAST_BODY),
        "had_duplicate_merge": F.lit(False),
        "source_rows": F.lit("[]"),
        "codebook": codebook_id(codebook),
    }
    return rows.select(*[values[c].alias(c) for c in CLAUSE_COLUMNS])


def tables(rows: DataFrame, document: str, version: str) -> DataFrame:
    """TABLE_COLUMNS of rows(table_number, title, description, footer_notes array, parent_reference, parent_number): the
    description, or a sentence in its place, with the notes below; the clause by reference, number or the table's own
    number."""
    number = F.coalesce(F.nullif(F.col("table_number"), F.lit("")), F.lit("Unknown"))
    bare = F.trim(F.regexp_replace(number, r"(?i)^table\s+", ""))
    # the parents of the table's own number, which is 'Unknown' where it has none
    above = F.get(st.candidate_parents(number), 0)
    own = F.get(st.candidate_parents(F.col("table_number")), 0)
    stateless = F.regexp_replace(above, rf"^(?:{st.STATES})\s+", "")
    lettered = F.regexp_extract(stateless, r"^([A-Z]+\d+)", 1)
    named = F.when(lettered != "", lettered).otherwise(F.split(stateless, r"\.")[0])
    section = F.when(above.isNotNull(), named).when(bare.contains("."), F.split(bare, r"\.")[0]).otherwise(F.split(bare, "_")[0])
    reference, parent = F.nullif(_text("parent_reference"), F.lit("")), F.nullif(_text("parent_number"), F.lit(""))
    said = F.when(reference.startswith("Clause "), reference).otherwise(F.concat(F.lit("Clause "), reference))
    clause = F.coalesce(said, F.concat(F.lit("Clause "), parent), F.concat(F.lit("Clause "), own), F.lit(""))
    by_id = F.coalesce(F.nullif(F.trim(F.replace(F.coalesce(parent, reference), F.lit("Clause "), F.lit(""))), F.lit("")), own, F.lit(""))
    plain = F.concat(number, F.lit(" ("), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled")), F.lit(") contains technical specifications."))
    content = F.coalesce(F.nullif(_text("description"), F.lit("")), plain)
    notes = F.array_join(F.filter(F.transform(F.coalesce("footer_notes", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    code = codebook_id(document)
    values = {
        "volume": F.when(code.contains("VOL3"), "Vol3").when(code.contains("VOL2"), "Vol2").otherwise("Vol1"),
        "part_code": section,
        "section_code": section,
        "table_id": number,
        "unit_type": F.lit("table"),
        "table_title": _text("title"),
        "table_content": F.when(notes == "", content).otherwise(F.trim(F.concat(F.rtrim(content), F.lit("\n\nNotes:\n"), notes))),
        "content_part": F.lit(1),
        "content_parts_total": F.lit(1),
        "called_in": F.lit(""),
        "clause_reference": clause,
        "source": F.lit(document),
        "context": F.lit(""),
        "clause_count": (by_id != "").cast("int"),
        "first_clause_id": by_id,
        "last_clause_id": by_id,
        "archived": F.lit("false"),
        "state_territory": F.lit(""),
        "source_file": F.lit("tables.json"),
        "version": F.lit(version),
    }
    return rows.select(*[values[c].alias(c) for c in TABLE_COLUMNS])
