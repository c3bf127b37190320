"""Every query with a SQL counterpart gives the same names, types and values."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect

FOLDER = "/root/testdata/sf0.01"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    actual = entry.queries()[name](spark, FOLDER).toPandas()
    assert len(actual) or name == "x15_high_hour_ranges"
    assert compare(actual, duck.execute(SQL[name]).fetchdf()) is None


def test_entry_returns_five_hours(spark):
    top = entry.entry(spark)
    assert top.columns == ["time_window", "hour", "mean", "median", "observations"]
    assert top.count() == 5


# Counters of the raw adapter, from its SQL form over all events.
REPORTS = {
    "0.001": (1020, 7, 113, 1, 18, 390, 492, (7, 9, 0, 4), 38, 151),
    "0.01": (10200, 96, 132, 26, 196, 9056, 720, (8, 15, 1, 8), 4, 2),
    "0.1": (102000, 1004, 130, 31, 1974, 98172, 720, (9, 15, 1, 10), 1, 2),
}


@pytest.mark.parametrize("scale", sorted(REPORTS))
def test_report_anchors(spark, scale):
    r = entry.queries()["q6_clean_report"](spark, f"/root/testdata/sf{scale}").first()
    invalid = tuple(r[f"invalid_{c}"] for c in ("temp", "rain_1h", "snow_1h", "clouds_all"))
    assert (
        r["rows_raw"], r["invalid_dates_removed"], r["missing_or_negative_target_removed"],
        r["holiday_days"], r["exact_duplicates_removed"], r["duplicate_timestamps_removed"],
        r["rows_clean"], invalid, r["zero_traffic_rows_kept"], r["time_gaps"],
    ) == REPORTS[scale]
