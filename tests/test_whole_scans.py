"""Scans give every row of their view."""

import pytest

from clausemill.plans import catalog
from clausemill.sources.derived import Views

SMALL = "/root/testdata/sf0.001"
#: query -> view
SCANS = {
    "B27_document_tables": "tables",
    "T12_chunk_page": "chunks",
    "S4_paged_scan": "chunks",
    "S5_ordered_scan": "chunks",
    "S6_table_scan": "tables",
}


@pytest.mark.parametrize("name", list(SCANS))
def test_every_row_is_there(spark, name):
    ids = sorted(r.id for r in catalog.QUERIES[name](spark, SMALL).collect())
    assert ids == sorted(r.id for r in getattr(Views(spark, SMALL), SCANS[name]).collect())
