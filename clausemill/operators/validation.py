"""Rules that clauses and tables are checked by, each document by itself. They give rows issues(document_id, type,
severity, clause_id, message); types and messages are fixed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions.structure import edged

TOC = r"\.{3,}"
TOC_LINE = r"(?m)\.{3,}.*\d+\s*$"
PROSE_TITLE = r"(?i)\b(shall|must not|must|in accordance with)\b"
STANDARD_NAME = r"(?i)^(AS/NZS|ISO|IEC|BS|EN)\s+\d+"
SINGLE = r"^\d{1,2}$"


def _issue(bad: Column, kind: str, severity: str, message: Column, clause: Column | None = None) -> Column:
    """The issue where bad holds, else null."""
    no_clause = F.lit(None).cast("string")
    return F.when(bad, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), (no_clause if clause is None else clause).alias("clause_id"), message.alias("message")))


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def found(df: DataFrame, *issues: Column) -> DataFrame:
    """The issues of all rows of df(document_id, ...), in one pass."""
    return df.select("document_id", F.explode(F.filter(F.array(*issues), lambda x: x.isNotNull())).alias("x")).select("document_id", "x.*")


# -- of a clause --------------------------------------------------------------------------------------

def empty_body() -> Column:
    return _issue(F.trim("body") == "", "empty_body", "warning", _say("Clause ", F.col("clause_number"), " has empty body"), F.col("clause_id"))


def orphan_note() -> Column:
    return _issue(F.col("has_notes") & (F.trim("body") == ""), "orphan_note", "warning", _say("Clause ", F.col("clause_number"), " has notes but no body"), F.col("clause_id"))


def toc_in_body() -> Column:
    return _issue(F.col("body").rlike(TOC), "toc_in_body", "error", _say("Clause ", F.col("clause_number"), " body contains TOC-style content (dot leaders)"), F.col("clause_id"))


def header_as_clause() -> Column:
    named = F.col("clause_number").rlike(SINGLE) & F.col("title").rlike(STANDARD_NAME)
    return _issue(named, "header_as_clause", "error", _say("Clause ", F.col("clause_number"), " has standard title '", F.col("title"), "' - likely a header/footer"), F.col("clause_id"))


def parent_consistency() -> Column:
    fields = (F.coalesce("parent_clause_id", F.lit("")) != "") | (F.coalesce("parent_clause_number", F.lit("")) != "")
    said = F.when(F.col("has_parent"), "has_parent=True but parent fields are null").otherwise("has_parent=False but parent fields are set")
    return _issue(F.col("has_parent") != fields, "inconsistent_parent", "error", _say("Clause ", F.col("clause_number"), ": ", said), F.col("clause_id"))


def missing_parent(clauses: DataFrame) -> DataFrame:
    known = clauses.select("document_id", F.col("clause_number").alias("parent_clause_number")).distinct()
    bad = clauses.where(F.coalesce("parent_clause_number", F.lit("")) != "").join(known, ["document_id", "parent_clause_number"], "left_anti")
    return found(bad, _issue(F.lit(True), "missing_parent", "error", _say("Clause ", F.col("clause_number"), " references non-existent parent ", F.col("parent_clause_number")), F.col("clause_id")))


def duplicate_number(clauses: DataFrame) -> DataFrame:
    bad = clauses.groupBy("document_id", "clause_number").agg(F.count("*").alias("n"))
    return found(bad, _issue(F.col("n") > 1, "duplicate_number", "error", _say("Duplicate clause number: ", F.col("clause_number"))))


# -- of a document's clauses --------------------------------------------------------------------------


def ratios(clauses: DataFrame) -> DataFrame:
    """A row for each document: its clauses n, how many are single digits, on page one, hierarchical, and with dot
    leaders, and the number of the first."""
    number = F.col("clause_number")
    return clauses.groupBy("document_id").agg(
        F.count("*").alias("n"),
        F.count_if(number.rlike(SINGLE)).alias("single"),
        F.count_if((F.col("page_start") == 1) & (F.col("page_end") == 1)).alias("page_one"),
        F.count_if(number.contains(".")).alias("deep"),
        F.count_if(F.col("body").rlike(TOC_LINE)).alias("toc"),
        F.min_by("clause_number", "ord").alias("first"),
    )


def single_digits() -> Column:
    return _issue(F.col("single") / F.col("n") > 0.3, "single_digit_contamination", "error", _say("Too many single-digit clause numbers (", F.col("single"), "/", F.col("n"), "). Likely parsing page numbers as clauses."))


def toc_contamination() -> Column:
    return _issue(F.col("toc") > 0, "toc_contamination", "error", _say(F.col("toc"), " clause(s) contain TOC-style dot leaders. Table of Contents not properly excluded."))


def page_tracking() -> Column:
    bad = (F.col("n") > 5) & (F.col("page_one") / F.col("n") > 0.7)
    return _issue(bad, "poor_page_tracking", "warning", _say(F.col("page_one"), "/", F.col("n"), " clauses attributed to page 1. Page tracking may not be working correctly."))


def poor_hierarchy() -> Column:
    bad = (F.col("n") > 10) & (F.col("deep") / F.col("n") < 0.3)
    return _issue(bad, "poor_hierarchy", "warning", _say("Only ", F.col("deep"), "/", F.col("n"), " clauses have hierarchical numbering. Expected more X.X.X style clauses in a structured document."))


def first_clause() -> Column:
    return _issue(~F.col("first").rlike("(?i)^(1|Appendix)"), "unexpected_first_clause", "warning", _say("First clause is '", F.col("first"), "', expected '1' or '1.1'"))


CLAUSE_RULES = [empty_body, orphan_note, toc_in_body, header_as_clause, parent_consistency]
DOCUMENT_RULES = [single_digits, toc_contamination, page_tracking, poor_hierarchy, first_clause]


def check_clauses(clauses: DataFrame) -> DataFrame:
    """All issues of clauses(document_id, ord, clause_id, clause_number, title, body, page_start, page_end,
    parent_clause_id, parent_clause_number, has_parent, has_notes): one pass for what a clause shows by itself, one for
    each document's counts, and one each for parents and numbers."""
    own = found(clauses, *[rule() for rule in CLAUSE_RULES])
    whole = found(ratios(clauses), *[rule() for rule in DOCUMENT_RULES])
    return reduce(DataFrame.unionAll, [own, whole, missing_parent(clauses), duplicate_number(clauses)])


# -- of tables ----------------------------------------------------------------------------------------


def empty_tables(tables: DataFrame) -> DataFrame:
    """tables(document_id, table_number, h, d): without header rows, and without data rows."""
    name = F.col("table_number")
    return found(
        tables,
        _issue(F.size("h") == 0, "missing_headers", "warning", _say("Table ", name, " has no header rows")),
        _issue(F.size("d") == 0, "empty_table", "warning", _say("Table ", name, " has no data rows")),
    )


def suspicious_title(tables: DataFrame) -> DataFrame:
    t = F.trim("title")
    bad = (F.coalesce("title", F.lit("")) != "") & ((F.length(t) > 100) | t.rlike(edged(PROSE_TITLE)) | t.rlike(r"^\d+(?:\.\d+)+\s+\S+"))
    shown = F.when(F.length("title") <= 100, F.col("title")).otherwise(F.concat(F.substring("title", 1, 97), F.lit("...")))
    return found(tables, _issue(bad, "suspicious_table_title", "warning", _say("Table ", F.col("table_number"), " title may include clause prose: ", shown)))


def duplicate_table(tables: DataFrame) -> DataFrame:
    bad = tables.where("table_number <> ''").groupBy("document_id", "table_number").agg(F.count("*").alias("n"))
    return found(bad, _issue(F.col("n") > 1, "duplicate_table_number", "warning", _say("Table number ", F.col("table_number"), " appears ", F.col("n"), " times in output (check merge/dedup)")))


def summary(issues: DataFrame) -> DataFrame:
    """A row for each document that has issues."""
    of = lambda s: F.count_if(F.col("severity") == s)
    return issues.groupBy("document_id").agg(F.count("*").alias("total_issues"), of("error").alias("errors"), of("warning").alias("warnings"), of("info").alias("info"))
