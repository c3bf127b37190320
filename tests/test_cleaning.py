import datetime as dt

import pytest
from pyspark.sql import functions as F

from observations import DEFECT_ROWS, RAW_DDL, hourly_rows, raw_frame, rows_of
from tidewatch import MissingColumnsError
from tidewatch import schema as S
from tidewatch.operators import cleaning as C
from tidewatch.operators import quality as Q
from tidewatch.plans import cleaning


def test_one_row_per_timestamp_and_counts(defects):
    cleaned = cleaning.clean(defects)
    r = cleaning.report(defects).first()
    assert cleaned.count() == cleaned.select(S.TIME).distinct().count() == 6 == r["rows_clean"]
    assert r["exact_duplicates_removed"] == 2 and r["duplicate_timestamps_removed"] == 1
    assert r["rows_raw"] == 9 and r["rows_removed"] == 3
    assert cleaned.where("hour = 18").first()["weather_main"] == "Rain"


def test_impossible_values_are_nulled_not_dropped(defects):
    r = cleaning.report(defects).first()
    assert [r[f"invalid_{c}"] for c in S.LIMITS] == [1, 1, 1, 1] and r["zero_traffic_rows_kept"] == 1
    cold = cleaning.clean(defects).where("hour = 3").first()
    assert cold["temp"] is None and cold["temp_c"] is None
    assert cold["traffic_volume"] == 120


def test_calendar_features(defects):
    r = cleaning.clean(defects).where("hour = 18").first()
    assert (r["day_name"], r["hour"], r["day"], r["month"], r["year"]) == ("Thursday", 18, 11, 11, 2021)
    assert (r["month_name"], r["day_of_week"], r["is_weekend"]) == ("Nov", 3, 0)
    assert r["date"] == dt.datetime(2021, 11, 11)
    assert r["temp_c"] == pytest.approx(281.4 - 273.15)
    assert cleaning.clean(defects).where("is_weekend = 1").select("day").distinct().count() == 2


def test_label_covers_its_day(defects):
    labelled = cleaning.clean(defects).where("day = 13").collect()
    assert {(r["holiday"], r["is_holiday"]) for r in labelled} == {("Harvest Home", 1)}
    assert len(labelled) == 2
    others = cleaning.clean(defects).where("day <> 13").collect()
    assert {(r["holiday"], r["is_holiday"]) for r in others} == {("None", 0)}


def test_label_survives_the_loss_of_its_row(spark):
    rows = [
        ("None", 280.0, 0.0, 0.0, 1, "A", "a", "2020-05-01 00:00:00", 10.0),
        ("May Day", 280.0, 0.0, 0.0, 2, "B", "b", "2020-05-01 00:00:00", 10.0),
        ("Later", 280.0, 0.0, 0.0, 2, "B", "b", "2020-05-01 05:00:00", 10.0),
    ]
    cleaned = cleaning.clean(raw_frame(spark, rows))
    assert {r["holiday"] for r in cleaned.collect()} == {"May Day"}
    assert cleaned.where("hour = 0").first()["weather_main"] == "A"


def test_text_fill_and_negative_target(spark):
    rows = [list(r) for r in DEFECT_ROWS]
    rows[0][5] = None
    rows[8][8] = -5.0
    cleaned = cleaning.clean(raw_frame(spark, rows))
    assert "Unknown" in {r["weather_main"] for r in cleaned.collect()}
    assert cleaned.where("traffic_volume < 0").count() == 0
    assert cleaning.report(raw_frame(spark, rows)).first()["missing_or_negative_target_removed"] == 1


TEXT_DDL = RAW_DDL.replace("double", "string").replace("clouds_all int", "clouds_all string")


@pytest.mark.parametrize("text, value", [
    ("12", 12.0), (" 5 ", 5.0), ("1e3", 1000.0), ("-2.5", -2.5), (".5", 0.5), ("inf", float("inf")),
    ("nan", None), ("abc", None), ("1.0d", None), ("0x1p3", None), ("", None), (None, None),
])
def test_number_coercion(spark, text, value):
    df = spark.createDataFrame([(text,)], "v string")
    assert C.coerce_numbers(df, ["v"]).first()["v"] == value


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),)], "v double")
    assert C.coerce_numbers(df, ["v"]).first()["v"] is None


@pytest.mark.parametrize("text, ok", [
    ("2019-03-01 07:00:00", True), ("2019-03-01", False), ("2019-02-30 07:00:00", False),
    ("2019-03-01 25:00:00", False), ("01.03.2019 07:00:00", False), (None, False),
])
def test_date_parsing(spark, text, ok):
    df = spark.createDataFrame([(text,)], f"{S.TIME} string")
    assert (C.parse_dates(df).first()[0] is not None) == ok


def test_bounds_are_inclusive(spark):
    rows = [
        ("None", t, rain, 0.0, c, "A", "a", f"2020-01-01 0{i}:00:00", 1.0)
        for i, (t, rain, c) in enumerate([(200.0, 0.0, 0), (330.0, 100.0, 100), (199.9, 100.1, 101), (330.1, -0.1, -1)])
    ]
    cleaned = cleaning.clean(raw_frame(spark, rows)).orderBy(S.TIME).collect()
    assert [r["temp"] for r in cleaned] == [200.0, 330.0, None, None]
    assert [r["rain_1h"] for r in cleaned] == [0.0, 100.0, None, None]
    assert [r["clouds_all"] for r in cleaned] == [0.0, 100.0, None, None]
    invalid = cleaning.report(raw_frame(spark, rows)).first()
    assert [invalid[f"invalid_{c}"] for c in S.LIMITS] == [2, 2, 0, 2]


def test_outliers_remove_nothing_and_one_day_filter(defects):
    cleaned = cleaning.clean(defects)
    table = {r["column"]: r for r in Q.outlier_summary(cleaned).collect()}
    assert "traffic_volume" in table and table["temp_c"]["outlier_pct"] >= 0
    assert cleaned.count() == 6
    assert C.filter_by_date(cleaned, "2021-11-13", "2021-11-13").count() == 2


def test_outlier_summary_skips_empty_and_absent_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (100.0, None)], "traffic_volume double, temp_c double")
    assert [r["column"] for r in Q.outlier_summary(df).collect()] == ["traffic_volume"]
    none = Q.outlier_summary(df.select(F.lit(1).alias("other")))
    assert none.count() == 0 and none.columns == Q.outlier_summary(df).columns


def test_cleaning_is_idempotent(defects):
    once = cleaning.clean(defects)
    raw_again = once.select(*S.REQUIRED_COLUMNS, S.ROW_ORD).withColumn(
        S.TIME, F.date_format(S.TIME, "yyyy-MM-dd HH:mm:ss")
    )
    twice = cleaning.clean(raw_again)
    columns = [*S.REQUIRED_COLUMNS, "temp_c", "is_holiday"]
    assert rows_of(once, *columns) == rows_of(twice, *columns)


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_result_does_not_depend_on_partitioning(spark, partitions):
    rows = hourly_rows(5) * 2 + DEFECT_ROWS
    base = raw_frame(spark, rows)
    shuffled = base.orderBy(F.rand(3)).repartition(partitions)
    columns = [S.ROW_ORD, *S.REQUIRED_COLUMNS]
    assert rows_of(cleaning.clean(base), *columns) == rows_of(cleaning.clean(shuffled), *columns)
    assert cleaning.report(base).first() == cleaning.report(shuffled).first()


def test_empty_and_single_row(spark):
    empty = raw_frame(spark, DEFECT_ROWS).limit(0)
    assert cleaning.clean(empty).count() == 0
    r = cleaning.report(empty).first()
    assert (r["rows_raw"], r["rows_clean"], r["time_gaps"], r["longest_gap_days"]) == (0, 0, 0, 0.0)
    one = cleaning.report(raw_frame(spark, DEFECT_ROWS[:1])).first()
    assert (one["rows_clean"], one["time_gaps"], one["longest_gap_days"]) == (1, 0, 0.0)
    assert cleaning.steps(empty).count() == 10


def test_only_rejected_rows(spark):
    rows = [(*DEFECT_ROWS[0][:7], "soon", 5.0), (*DEFECT_ROWS[0][:8], None)]
    r = cleaning.report(raw_frame(spark, rows)).first()
    assert (r["rows_raw"], r["invalid_dates_removed"], r["missing_or_negative_target_removed"]) == (2, 1, 1)
    assert r["rows_clean"] == 0 and r["holiday_days"] == 0


def times(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(
        F.col("t").cast("timestamp_ntz").alias(S.TIME)
    )


@pytest.mark.parametrize("texts, gaps, longest", [
    (["2020-01-01 00:00:00", "2020-01-01 01:00:00"], 0, 0.0),
    (["2020-01-01 00:00:00", "2020-01-01 01:00:01"], 1, 0.0),
    (["2020-01-01 00:30:00", "2020-01-01 01:20:00", "2020-01-05 01:20:00"], 1, 4.0),
    (["2020-01-01 23:30:00", "2020-01-02 00:20:00"], 0, 0.0),
    (["2020-01-01 10:00:00", "2020-01-01 22:00:00", "2020-01-03 10:00:00"], 2, 1.5),
    ([], 0, 0.0),
])
def test_gaps(spark, texts, gaps, longest):
    df = times(spark, *texts) if texts else times(spark, "2020-01-01 00:00:00").limit(0)
    r = Q.time_gaps(df).first()
    assert (r["time_gaps"], r["longest_gap_days"]) == (gaps, longest)


def test_no_session_zone_leaks_in(spark, defects):
    """Times without a zone must not pass through one; this night lacks 02:00 in New York."""
    rows = [(*DEFECT_ROWS[0][:7], f"2021-03-14 0{h}:00:00", 5.0) for h in range(5)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        cleaned = cleaning.clean(raw_frame(spark, rows))
        assert sorted(r["hour"] for r in cleaned.collect()) == [0, 1, 2, 3, 4]
        r = Q.time_gaps(times(spark, "2021-03-13 12:00:00", "2021-03-14 12:00:00")).first()
        assert (r["time_gaps"], r["longest_gap_days"]) == (1, 1.0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_raw_table_must_have_its_columns(spark):
    with pytest.raises(MissingColumnsError):
        cleaning.clean(spark.createDataFrame([(1,)], "a int"))
