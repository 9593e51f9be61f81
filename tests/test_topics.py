"""Topic keys with the source that an item comes from."""

import pytest

from clausemill.functions import reports as r
from clausemill.operators import reports as rp

CASES = [
    ("Fire alarm and warning systems", "AS_16704", "ewis_warning"),
    ("Fire Detection & Alarm", "AS 1670.1", "fire_detection"),
    ("Fire Detection & Alarm", "AS 1670.4", "ewis_warning"),
    ("Smoke detectors", "AS1670.4", "fire_detection"),
    ("Fire Detection & Alarm", "", "fire_detection"),
    ("Intercom", "", "ewis_warning"),
    ("", "", "general"),
    (None, None, "general"),
]


@pytest.mark.parametrize("domain, source, key", CASES)
def test_topic(spark, domain, source, key):
    df = spark.createDataFrame([(domain, source)], "domain string, source string")
    assert df.select(r.topic(df.domain, df.source)).first()[0] == key


def test_detection_and_warning_stay_apart(spark):
    rows = [
        (1, 1, "req_fd", "Fire Detection & Alarm", "conditional", "FDCIE and FBP for 8 storeys.", "c1", "AS 1670.1"),
        (1, 2, "req_ewis", "Fire alarm and warning systems", "conditional", "EWIS zones and WIP locations.", "c2", "AS_16704"),
        (1, 3, "req_ewis", "Fire Detection & Alarm", "applies", "Speakers on each floor.", "c3", "AS 1670.4"),
    ]
    df = spark.createDataFrame(rows, "project long, ord long, requirement_id string, domain string, status string, summary string, evidence string, label string")
    found = {x.topic: (x.status, x.ids) for x in rp.merged(df).collect()}
    assert found == {"fire_detection": ("conditional", ["c1"]), "ewis_warning": ("applies", ["c2", "c3"])}
