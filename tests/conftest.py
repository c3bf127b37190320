from __future__ import annotations

import tempfile

import pytest
from observations import DEFECT_ROWS, hourly_rows, raw_frame

from tidewatch import schema as S
from tidewatch.plans.cleaning import clean
from tidewatch.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="tests-")},
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def defects(spark):
    return raw_frame(spark, DEFECT_ROWS)


@pytest.fixture(scope="session")
def series(spark):
    """Ten clean weeks of hourly observations."""
    return clean(raw_frame(spark, hourly_rows(70))).select(
        S.ROW_ORD, *S.REQUIRED_COLUMNS, "temp_c", "hour", "day", "month", "year", "day_of_week",
        "day_name", "month_name", "is_weekend", "is_holiday", "date",
    ).persist()
