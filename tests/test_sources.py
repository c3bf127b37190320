import gzip

import pytest

from observations import DEFECT_ROWS
from tidewatch import MissingColumnsError, SourceNotFoundError
from tidewatch import schema as S
from tidewatch.operators import anomalies as N
from tidewatch.operators import cleaning as C
from tidewatch.operators.quality import describe_columns
from tidewatch.plans.cleaning import clean, report
from tidewatch.sources import readers, writers


def csv_text(rows=DEFECT_ROWS, columns=S.REQUIRED_COLUMNS, header=None):
    def field(value):
        text = "" if value is None else str(value)
        return '"' + text.replace('"', '""') + '"' if "," in text or '"' in text else text

    order = [S.REQUIRED_COLUMNS.index(c) for c in columns]
    lines = [",".join(header or columns)]
    lines += [",".join(field(r[i]) for i in order) for r in rows]
    return "\n".join(lines) + "\n"


def test_missing_path_names_the_download(spark, tmp_path):
    with pytest.raises(SourceNotFoundError, match="(?i)download"):
        readers.read_raw_csv(spark, str(tmp_path / "nowhere.csv"))


def test_missing_columns_are_listed(spark, tmp_path):
    path = tmp_path / "other.csv"
    path.write_text("p,q\n1,2\n")
    with pytest.raises(MissingColumnsError, match="traffic_volume.*'p', 'q'"):
        readers.read_raw_csv(spark, str(path))


@pytest.mark.parametrize("name", ["plain.csv", "packed.csv.gz"])
def test_csv_and_gzip_load_alike(spark, tmp_path, name):
    path = tmp_path / name
    data = csv_text().encode()
    path.write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    raw = readers.read_raw_csv(spark, str(path))
    assert raw.columns == [*S.REQUIRED_COLUMNS, S.ROW_ORD]
    rows = describe_columns(raw, S.REQUIRED_COLUMNS).collect()
    assert {r["rows"] for r in rows} == {9} and len(rows) == 9
    assert {r["column"]: r["missing"] for r in rows}["holiday"] == 8
    assert clean(raw).count() == 6
    assert report(raw).first()["exact_duplicates_removed"] == 2


def test_corrupt_gzip_is_a_value_error(spark, tmp_path):
    path = tmp_path / "broken.csv.gz"
    path.write_bytes(b"this is not gzip")
    with pytest.raises(ValueError, match="broken.csv.gz"):
        readers.read_raw_csv(spark, str(path)).count()


def test_gzip_damaged_past_its_header_is_a_value_error(spark, tmp_path):
    path = tmp_path / "cut.csv.gz"
    whole = gzip.compress(csv_text([(*DEFECT_ROWS[0][:8], float(i * 7919 % 1000)) for i in range(20_000)]).encode())
    path.write_bytes(whole[: len(whole) // 2])
    with pytest.raises(ValueError, match="cut.csv.gz"):
        readers.read_raw_csv(spark, str(path))


def test_line_breaks_within_quotes(spark, tmp_path):
    rows = [list(r) for r in DEFECT_ROWS]
    rows[0][6] = "two\nlines"
    path = tmp_path / "breaks.csv"
    path.write_text(csv_text(rows).replace("two\nlines", '"two\nlines"'))
    raw = readers.read_raw_csv(spark, str(path))
    assert raw.count() == len(rows) and readers.preview(raw, 1).first()["weather_description"] == "two\nlines"


def test_described_types_are_those_of_the_values(spark, tmp_path):
    path = tmp_path / "typed.csv"
    path.write_text(csv_text())
    kinds = {r["column"]: r["data_type"] for r in describe_columns(readers.read_raw_csv(spark, str(path)), S.REQUIRED_COLUMNS).collect()}
    assert (kinds["temp"], kinds["clouds_all"], kinds["traffic_volume"], kinds["weather_main"], kinds["date_time"]) == (
        "double", "bigint", "double", "string", "string")


def test_columns_go_by_header_name_and_quotes_are_kept(spark, tmp_path):
    rows = [list(r) for r in DEFECT_ROWS]
    rows[0][6] = 'say "thin", please'
    path = tmp_path / "reordered.csv"
    path.write_text(csv_text(rows, list(reversed(S.REQUIRED_COLUMNS))))
    raw = readers.read_raw_csv(spark, str(path))
    first = readers.preview(raw, 1).first()
    assert first["weather_description"] == 'say "thin", please'
    assert first["traffic_volume"] == "3100.0" and first["holiday"] is None


def test_extra_columns_flow_through(spark, tmp_path):
    path = tmp_path / "wide.csv"
    lines = csv_text().splitlines()
    path.write_text("\n".join([lines[0] + ",station"] + [line + ",west" for line in lines[1:]]) + "\n")
    cleaned = clean(readers.read_raw_csv(spark, str(path)))
    assert {r["station"] for r in cleaned.select("station").collect()} == {"west"}


def test_files_with_other_header_order_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text(csv_text())
    (tmp_path / "b.csv").write_text(csv_text(columns=list(reversed(S.REQUIRED_COLUMNS))))
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_raw_csv(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("token", ["", "NA", "null", "None", "NaN", "n/a"])
def test_missing_tokens(spark, tmp_path, token):
    rows = [list(DEFECT_ROWS[0])]
    rows[0][5] = token
    path = tmp_path / "t.csv"
    path.write_text(csv_text(rows))
    assert readers.read_raw_csv(spark, str(path)).first()["weather_main"] is None


def test_preview_is_in_input_order(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text(csv_text([(*DEFECT_ROWS[0][:8], float(i)) for i in range(500)]))
    raw = readers.read_raw_csv(spark, str(path)).repartition(7)
    assert [r["traffic_volume"] for r in readers.preview(raw).collect()] == [f"{i}.0" for i in range(10)]


def test_parquet_row_order(spark, tmp_path, defects):
    defects.drop(S.ROW_ORD).coalesce(1).write.parquet(str(tmp_path / "p"))
    back = readers.with_row_ord(spark.read.parquet(str(tmp_path / "p")))
    assert clean(back).where("hour = 18").first()["weather_main"] == "Rain"


def test_clean_table_round_trip_prunes_months(spark, tmp_path, series):
    path = str(tmp_path / "clean")
    writers.write_clean(series, path)
    back = readers.read_clean(spark, path)
    assert back.count() == series.count()
    some = C.filter_by_date(back, "2022-10-01", "2022-10-03", partitioned=True)
    assert some.count() == 72
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [((" in plan
    assert "PushedFilters: [IsNotNull(date_time)" in plan
    with pytest.raises(SourceNotFoundError):
        readers.read_clean(spark, str(tmp_path / "none"))


def test_flagged_rows_to_csv(spark, tmp_path, series):
    table = N.anomaly_table(N.flag_anomalies(series))
    writers.write_rows(table, str(tmp_path / "flags"), "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "flags"))
    assert back.columns == N.TABLE_COLUMNS and back.count() == table.count() > 0
    writers.write_rows(table, str(tmp_path / "flags_pq"))
    assert spark.read.parquet(str(tmp_path / "flags_pq")).count() == table.count()
