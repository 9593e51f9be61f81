"""Validation rules over clauses and tables."""

from pyspark.sql import functions as F

from clausemill.functions import structure as st
from clausemill.operators import validation as va

from .registry import query


def _issue(kind: str, severity: str, message: str, source: str, clause: str = "NULL::VARCHAR") -> str:
    return f"SELECT document_id, '{kind}' AS type, '{severity}' AS severity, {clause} AS clause_id, {message} AS message FROM {source}"


_R = "(SELECT document_id, arg_min(clause_number, ord) AS first, count(*) AS n, count(*) FILTER (regexp_matches(clause_number, '^[0-9]{1,2}$')) AS single, count(*) FILTER (page_start = 1 AND page_end = 1) AS page_one, count(*) FILTER (contains(clause_number, '.')) AS deep, count(*) FILTER (regexp_matches(body, '(?m)\\.{3,}.*[0-9]+\\s*$')) AS toc FROM clauses GROUP BY document_id)"
_EMPTY = _issue("empty_body", "warning", "concat('Clause ', clause_number, ' has empty body')", "clauses WHERE trim(body) = ''", "clause_id")
_MISSING = _issue("missing_parent", "error", "concat('Clause ', clause_number, ' references non-existent parent ', parent_clause_number)", "clauses c WHERE coalesce(parent_clause_number, '') <> '' AND NOT EXISTS (SELECT 1 FROM clauses p WHERE p.document_id = c.document_id AND p.clause_number = c.parent_clause_number)", "clause_id")
_NOTE = _issue("orphan_note", "warning", "concat('Clause ', clause_number, ' has notes but no body')", "clauses WHERE has_notes AND trim(body) = ''", "clause_id")
_TOC = _issue("toc_in_body", "error", "concat('Clause ', clause_number, ' body contains TOC-style content (dot leaders)')", "clauses WHERE contains(body, '...')", "clause_id")
_DUP = _issue("duplicate_number", "error", "concat('Duplicate clause number: ', clause_number)", "(SELECT document_id, clause_number FROM clauses GROUP BY document_id, clause_number HAVING count(*) > 1)")
_SINGLE = _issue("single_digit_contamination", "error", "concat('Too many single-digit clause numbers (', single, '/', n, '). Likely parsing page numbers as clauses.')", f"{_R} WHERE n > 0 AND single / n > 0.3") + " UNION ALL " + _issue("header_as_clause", "error", "concat('Clause ', clause_number, ' has standard title ''', title, ''' - likely a header/footer')", "clauses WHERE regexp_matches(clause_number, '^[0-9]{1,2}$') AND regexp_matches(title, '(?i)^(AS/NZS|ISO|IEC|BS|EN)\\s+[0-9]+')", "clause_id")
_TOCS = _issue("toc_contamination", "error", "concat(toc, ' clause(s) contain TOC-style dot leaders. Table of Contents not properly excluded.')", f"{_R} WHERE toc > 0")
_PAGE = _issue("poor_page_tracking", "warning", "concat(page_one, '/', n, ' clauses attributed to page 1. Page tracking may not be working correctly.')", f"{_R} WHERE n > 5 AND page_one / n > 0.7")
_SET = "(coalesce(parent_clause_id, '') <> '' OR coalesce(parent_clause_number, '') <> '')"
_CONS = _issue("inconsistent_parent", "error", "concat('Clause ', clause_number, ': ', CASE WHEN has_parent THEN 'has_parent=True but parent fields are null' ELSE 'has_parent=False but parent fields are set' END)", f"clauses WHERE has_parent <> {_SET}", "clause_id")
_HIER = _issue("poor_hierarchy", "warning", "concat('Only ', deep, '/', n, ' clauses have hierarchical numbering. Expected more X.X.X style clauses in a structured document.')", f"{_R} WHERE n > 10 AND deep / n < 0.3") + " UNION ALL " + _issue("unexpected_first_clause", "warning", "concat('First clause is ''', first, ''', expected ''1'' or ''1.1''')", f"{_R} WHERE NOT regexp_matches(first, '(?i)^(1|Appendix)')")

_clause = lambda *rules: lambda c: va.found(c, *[r() for r in rules])
_document = lambda *rules: lambda c: va.found(va.ratios(c), *[r() for r in rules])

for _name, _sql, _check in (
    ("V1_empty_body", _EMPTY, _clause(va.empty_body)),
    ("V2_missing_parent", _MISSING, va.missing_parent),
    ("V3_orphan_note", _NOTE, _clause(va.orphan_note)),
    ("V4_toc_in_body", _TOC, _clause(va.toc_in_body)),
    ("V5_duplicate_number", _DUP, va.duplicate_number),
    ("V9_single_digits", _SINGLE, lambda c: _document(va.single_digits)(c).unionAll(_clause(va.header_as_clause)(c))),
    ("V10_toc_contamination", _TOCS, _document(va.toc_contamination)),
    ("V11_page_tracking", _PAGE, _document(va.page_tracking)),
    ("V12_parent_consistency", _CONS, _clause(va.parent_consistency)),
    ("V13_hierarchy", _HIER, _document(va.poor_hierarchy, va.first_clause)),
):

    @query(_name, _sql)
    def _(v, check=_check):
        return check(v.clauses)


_ALL = " UNION ALL ".join([_EMPTY, _MISSING, _NOTE, _TOC, _DUP, _SINGLE, _TOCS, _PAGE, _CONS, _HIER])


@query("A22_issue_summary", f"SELECT document_id, count(*) AS total_issues, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS info FROM ({_ALL}) GROUP BY document_id")
def _(v):
    return va.summary(va.check_clauses(v.clauses))


@query("A20_validation_ratios", f"SELECT document_id, first, n, single, page_one, deep, toc, round(single / n, 9) AS single_ratio, round(deep / n, 9) AS deep_ratio FROM {_R}")
def _(v):
    return va.ratios(v.clauses).withColumns({"single_ratio": F.round(F.col("single") / F.col("n"), 9), "deep_ratio": F.round(F.col("deep") / F.col("n"), 9)})


@query("A21_duplicates", "SELECT document_id, 'clause' AS kind, clause_number AS number, count(*) AS n FROM clauses GROUP BY document_id, clause_number HAVING count(*) > 1 UNION ALL SELECT document_id, 'table', table_number, count(*) FROM tables GROUP BY document_id, table_number HAVING count(*) > 1")
def _(v):
    one = lambda df, kind, c: df.groupBy("document_id", F.col(c).alias("number")).agg(F.count("*").alias("n")).where("n > 1").select("document_id", F.lit(kind).alias("kind"), "number", "n")
    return one(v.clauses, "clause", "clause_number").unionAll(one(v.tables, "table", "table_number"))


@query("A23_content_stats", "SELECT document_id, count(*) AS total, count(*) FILTER (length(body) > 0) AS with_content, count(*) FILTER (length(body) > 100) AS substantial, (count(*) FILTER (length(body) > 0) * 100 // count(*))::BIGINT AS percent FROM clauses GROUP BY document_id")
def _(v):
    some, much = F.count_if(F.length("body") > 0), F.count_if(F.length("body") > 100)
    return v.clauses.groupBy("document_id").agg(F.count("*").alias("total"), some.alias("with_content"), much.alias("substantial"), F.floor(some * 100 / F.count("*")).cast("long").alias("percent"))


_T = "(SELECT id // 4 AS document_id, table_number, CASE WHEN header = '' THEN 0 ELSE 1 END AS nh, CASE WHEN data = '' THEN 0 ELSE 1 END AS nd FROM grids)"


@query("V6_empty_tables", _issue("missing_headers", "warning", "concat('Table ', table_number, ' has no header rows')", f"{_T} WHERE nh = 0") + " UNION ALL " + _issue("empty_table", "warning", "concat('Table ', table_number, ' has no data rows')", f"{_T} WHERE nd = 0"))
def _(v):
    return va.empty_tables(v.grids.select(F.floor(F.col("id") / 4).alias("document_id"), "table_number", st.cells(F.col("header")).alias("h"), st.cells(F.col("data")).alias("d")))


_TITLED = "(SELECT document_id, table_number, CASE WHEN id % 9 = 0 THEN '2.4 ' || title WHEN id % 9 = 1 THEN title || ' shall be' WHEN id % 9 = 2 THEN title || text ELSE title END AS title FROM tables)"


@query("V7_suspicious_title", _issue("suspicious_table_title", "warning", "concat('Table ', table_number, ' title may include clause prose: ', CASE WHEN length(title) <= 100 THEN title ELSE substring(title, 1, 97) || '...' END)", f"{_TITLED} WHERE coalesce(title, '') <> '' AND (length(trim(title)) > 100 OR regexp_matches(trim(title), '(?i)\\b(shall|must not|must|in accordance with)\\b') OR regexp_matches(trim(title), '^[0-9]+(?:\\.[0-9]+)+\\s+\\S+'))"))
def _(v):
    k = F.col("id") % 9
    title = F.when(k == 0, F.concat(F.lit("2.4 "), "title")).when(k == 1, F.concat("title", F.lit(" shall be"))).when(k == 2, F.concat("title", "text")).otherwise(F.col("title"))
    return va.suspicious_title(v.tables.select("document_id", "table_number", title.alias("title")))


@query("V8_duplicate_table", _issue("duplicate_table_number", "warning", "concat('Table number ', table_number, ' appears ', n, ' times in output (check merge/dedup)')", "(SELECT document_id, table_number, count(*) AS n FROM tables WHERE table_number <> '' GROUP BY document_id, table_number HAVING count(*) > 1)"))
def _(v):
    return va.duplicate_table(v.tables)
