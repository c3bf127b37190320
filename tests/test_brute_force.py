"""Random dirty tables against row-by-row Python that states the rules one at a time."""

import datetime as dt
import itertools
import math
from random import Random

import pytest

from observations import rows_of
from tidewatch import schema as S
from tidewatch.operators import anomalies as N
from tidewatch.operators import quality as Q
from tidewatch.plans import cleaning

DDL = ", ".join(f"{c} string" for c in S.REQUIRED_COLUMNS) + ", row_ord long"


def random_rows(seed: int, n: int = 400):
    rng = Random(seed)
    start = dt.datetime(2021, 12, 30)

    def number(low, high, odd):
        return rng.choice(odd) if rng.random() < 0.1 else str(round(rng.uniform(low, high), 1))

    rows = []
    for _ in range(n):
        ts = start + dt.timedelta(hours=rng.randrange(0, 200) if rng.random() < 0.9 else rng.randrange(400, 500))
        text = ts.strftime("%Y-%m-%d %H:%M:%S")
        if rng.random() < 0.05:
            text = rng.choice(["", "2021-12-31", "31.12.2021 10:00", "soon", None])
        rows.append((
            rng.choice(["Feast", "Fair", None]) if ts.hour == 0 else rng.choice(["None", None]),
            number(260, 300, ["0", "999", "nan", "x", None]),
            number(0, 5, ["-1", "9831.3", "", None]),
            number(0, 1, ["101", "y"]),
            str(rng.choice([0, 40, 100, 101, -3])),
            rng.choice(["Clear", "Rain", None]),
            rng.choice(["a", "b", None]),
            text,
            number(0, 5000, ["-5", "0", "many", None]),
        ))
    rows += rng.sample(rows, n // 8)
    rng.shuffle(rows)
    return [(*r, i) for i, r in enumerate(rows)]


def as_number(text):
    try:
        value = float(text)
    except (TypeError, ValueError):
        return None
    return None if math.isnan(value) else value


def as_time(text):
    try:
        return dt.datetime.strptime(text, "%Y-%m-%d %H:%M:%S")
    except (TypeError, ValueError):
        return None


def expected(rows):
    counts = {"rows_raw": len(rows)}
    typed = []
    for r in rows:
        row = dict(zip([*S.REQUIRED_COLUMNS, "row_ord"], r))
        row["date_time"] = as_time(row["date_time"])
        for c in S.NUMERIC_COLUMNS:
            row[c] = as_number(row[c])
        typed.append(row)
    dated = [r for r in typed if r["date_time"] is not None]
    counts["invalid_dates_removed"] = len(typed) - len(dated)
    valid = [r for r in dated if r["traffic_volume"] is not None and r["traffic_volume"] >= 0]
    counts["missing_or_negative_target_removed"] = len(dated) - len(valid)

    labels = {}
    for r in valid:
        if r["holiday"] not in (None, "None"):
            labels.setdefault(r["date_time"].date(), r["holiday"])
    counts["holiday_days"] = len(labels)
    distinct = {tuple(r[c] for c in S.REQUIRED_COLUMNS) for r in valid}
    counts["exact_duplicates_removed"] = len(valid) - len(distinct)

    kept = {}
    for r in valid:
        kept.setdefault(r["date_time"], r)
    counts["duplicate_timestamps_removed"] = len(distinct) - len(kept)
    counts["rows_clean"] = len(kept)
    counts["rows_removed"] = len(rows) - len(kept)
    counts["zero_traffic_rows_kept"] = sum(r["traffic_volume"] == 0 for r in kept.values())
    for c, (low, high) in S.LIMITS.items():
        bad = [r for r in kept.values() if r[c] is not None and not low <= r[c] <= high]
        counts[f"invalid_{c}"] = len(bad)
        for r in bad:
            r[c] = None
    for r in kept.values():
        r["holiday"] = labels.get(r["date_time"].date(), "None")
        r["weather_main"] = r["weather_main"] or "Unknown"
        r["weather_description"] = r["weather_description"] or "Unknown"
    gaps = [b - a for a, b in itertools.pairwise(sorted(kept))]
    counts["time_gaps"] = sum(g > dt.timedelta(hours=1) for g in gaps)
    counts["longest_gap_days"] = round(max(gaps) / dt.timedelta(days=1), 1)
    return kept, counts


@pytest.mark.parametrize("seed", range(6))
def test_cleaning(spark, seed):
    rows = random_rows(seed)
    kept, counts = expected(rows)
    raw = spark.createDataFrame(rows, DDL).repartition(6)
    columns = [*S.REQUIRED_COLUMNS, "row_ord"]
    got = rows_of(cleaning.clean(raw), *columns)
    want = sorted((tuple(r[c] for c in columns) for r in kept.values()),
                  key=lambda r: [(v is not None, str(v)) for v in r])
    assert got == want
    assert cleaning.report(raw).first().asDict() == counts
    remaining = {r["column"]: r["missing"] for r in Q.remaining_missing(cleaning.clean(raw)).collect()}
    nulls = {c: sum(r[c] is None for r in kept.values()) for c in S.LIMITS}
    assert remaining == {c: n for c, n in {**nulls, "temp_c": nulls["temp"]}.items() if n}


@pytest.mark.parametrize("seed", range(3))
def test_anomalies(spark, seed):
    """Limits per group from sorted lists and linear interpolation."""
    cleaned = cleaning.clean(spark.createDataFrame(random_rows(seed, 900), DDL)).persist()
    rows = cleaned.select("row_ord", "weather_main", S.TARGET).collect()

    def quantile(values, p):
        values = sorted(values)
        at = p * (len(values) - 1)
        low = values[math.floor(at)]
        return low + (values[math.ceil(at)] - low) * (at - math.floor(at))

    limits = {}
    for group in {r["weather_main"] for r in rows}:
        values = [r[S.TARGET] for r in rows if r["weather_main"] == group]
        q1, q3 = quantile(values, 0.25), quantile(values, 0.75)
        limits[group] = (q1 - 0.3 * (q3 - q1), q3 + 0.3 * (q3 - q1))
    want = {}
    for r in rows:
        low, high = limits[r["weather_main"]]
        want[r["row_ord"]] = "High" if r[S.TARGET] > high else "Low" if r[S.TARGET] < low else "Normal"
    for distributed in (True, False):
        flagged = N.flag_anomalies(cleaned, ["weather_main"], 0.3, distributed=distributed)
        assert {r["row_ord"]: r["anomaly_type"] for r in flagged.collect()} == want
    assert set(want.values()) == {"High", "Low", "Normal"}
