"""Every query of the catalogue against its SQL twin."""

import pytest
from twins import differences

from clausemill.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_gives_what_its_sql_gives(spark, name):
    if name in catalog.SQL:
        assert differences(spark, SMALL, catalog.QUERIES[name], catalog.SQL[name]) == ""
    else:
        assert catalog.QUERIES[name](spark, SMALL).count() > 0
