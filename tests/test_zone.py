"""Results over zone-less times do not depend on the session zone."""

import pytest

import __spark_entry__ as entry
from observations import rows_of

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "c1_parse_dates", "c9_features", "c10_clean", "c11_date_filter", "c12_bounds", "q4_time_gaps",
    "q6_clean_report", "a11_resample_daily", "a11_resample_weekly", "a11_resample_monthly",
    "f1_findings", "l1_split", "l12_window_view", "l13_split_facts", "t2_top_observations",
]


@pytest.mark.parametrize("name", NAMES)
def test_same_in_another_zone(spark, name):
    query = entry.queries()[name]
    before = spark.conf.get("spark.sql.session.timeZone")
    here = rows_of(query(spark, FOLDER))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kathmandu")
    try:
        assert rows_of(query(spark, FOLDER)) == here
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
