"""Rules hold inside a document: two documents that share numbers, against plain expectations."""

from clausemill.operators import structuring as sg
from clausemill.operators import validation as va

COLUMNS = "document_id long, ord long, clause_id string, clause_number string, title string, body string, level int, page_start int, page_end int, parent_clause_id string, parent_clause_number string, has_parent boolean, has_notes boolean"


def clause(doc, ord_, number, body="Some body.", title="T", level=2, pages=(1, 1), parent=None):
    return (doc, ord_, f"c{ord_}", number, title, body, level, *pages, None, parent, parent is not None, False)


def issues(spark, rows):
    found = va.check_clauses(spark.createDataFrame(rows, COLUMNS)).collect()
    return sorted((r.document_id, r.type, r.clause_id or "") for r in found)


def test_numbers_parents_and_ratios_are_of_one_document(spark):
    one = [clause(1, 1, "1"), clause(1, 2, "1.1", parent="1"), clause(1, 3, "1.2", parent="9"), clause(1, 4, "1.2")]
    two = [clause(2, 11, "1.1", parent="1"), clause(2, 12, "9"), clause(2, 13, "7", body="")]
    assert issues(spark, one + two) == sorted([
        (1, "missing_parent", "c3"), (1, "duplicate_number", ""),
        (2, "missing_parent", "c11"), (2, "single_digit_contamination", ""), (2, "empty_body", "c13"),
    ])


def test_ratios_are_counted_for_each_document(spark):
    rows = [clause(d, 100 * d + i, f"{i + 1}.1", pages=(1, 1) if d == 1 else (i + 2, i + 2)) for d in (1, 2) for i in range(6)]
    r = {x.document_id: x for x in va.ratios(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert (r[1].page_one, r[2].page_one, r[1].n, r[2].first) == (6, 0, 6, "1.1")
    assert issues(spark, rows) == [(1, "poor_page_tracking", "")]
    assert {x.document_id: x.warnings for x in va.summary(va.check_clauses(spark.createDataFrame(rows, COLUMNS))).collect()} == {1: 1}


def links(spark, tables, clauses):
    t = spark.createDataFrame(tables, "document_id long, id long, table_number string, page_start int")
    return {r.id: r.ord for r in sg.clause_of_table(t, spark.createDataFrame(clauses, COLUMNS)).collect()}


def test_a_table_takes_a_clause_of_its_own_document(spark):
    clauses = [
        clause(1, 1, "3.6", pages=(5, 6)), clause(1, 2, "3.6.1", level=3, pages=(6, 6)), clause(1, 3, "3.6", pages=(9, 9)), clause(1, 4, "8", level=3, pages=(6, 6)),
        clause(2, 11, "3.6.1", pages=(2, 2)), clause(2, 12, "C3P1", pages=(20, 20)),
    ]
    tables = [
        (1, 1, "3.6.1", 1),  # its own number
        (1, 2, "Table 3.6.9", 1),  # the last of the equal numbers above it
        (1, 3, "MODAL_P6_1", 6),  # the first of the deepest on the page
        (1, 4, "", 7),  # the page before
        (1, 5, "77", 4),  # the page behind
        (1, 6, None, 30),  # nothing near
        (2, 7, "Table C3P1a", 1),  # the parent that the number names
        (2, 8, "3.6", 3),  # not the other document's 3.6
    ]
    assert links(spark, tables, clauses) == {1: 2, 2: 3, 3: 2, 4: 2, 5: 1, 6: None, 7: 12, 8: 11}
