"""The same results in plain SQL, written independently of the Spark operators."""

from __future__ import annotations

_TIME_SHAPE = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


def _r(expr: str, digits: int = 6) -> str:
    """Half-even rounding on the scaled value, further digits settled first; adding 0 turns
    -0.0 into 0.0."""
    more = 6 if digits <= 2 else 3
    settled = f"round_even(CAST(({expr}) AS DOUBLE) * 1e{digits} * 1e{more}, 0) / 1e{more}"
    return f"(round_even({settled}, 0) / 1e{digits} + 0e0)"


_WEATHER = """
    CASE WHEN event_type = 'signup' AND k IN (7, 8) THEN concat('Day ', CAST(k AS VARCHAR)) ELSE 'None' END AS holiday,
    CASE WHEN k = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(260 AS DOUBLE) + k * CAST(0.4 AS DOUBLE) END AS temp,
    CASE WHEN event_type = 'error' THEN value ELSE CAST(0 AS DOUBLE) END AS rain_1h,
    CASE WHEN event_type = 'view' AND k > 90 THEN value ELSE CAST(0 AS DOUBLE) END AS snow_1h,
    CASE WHEN k = 99 THEN 120 ELSE k END AS clouds_all
"""

_RAW = f"""
e AS (
  SELECT * REPLACE (CASE WHEN ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 06:00:00'
      THEN ts + INTERVAL 90 DAY ELSE ts END AS ts),
    CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events
), once AS (
  SELECT event_id * 2 AS row_ord, {_WEATHER},
    CASE WHEN k = 50 THEN NULL ELSE event_type END AS weather_main,
    CASE WHEN k = 50 THEN NULL ELSE concat(event_type, ' ', CAST(k AS VARCHAR)) END AS weather_description,
    CASE WHEN k = 98 THEN 'not a date' ELSE CAST(date_trunc('hour', ts) AS VARCHAR) END AS date_time,
    CASE WHEN user_id = 0 THEN NULL WHEN user_id = 1 THEN -value
         WHEN user_id = 2 THEN CAST(0 AS DOUBLE) ELSE value * 10 END AS traffic_volume
  FROM e
), raw AS (
  SELECT * FROM once
  UNION ALL
  SELECT row_ord + 1, * EXCLUDE (row_ord) FROM once WHERE row_ord % 100 = 0
)"""

_VALID = f"""{_RAW}, parsed AS (
  SELECT * REPLACE (
    CAST(clouds_all AS DOUBLE) AS clouds_all,
    CASE WHEN regexp_matches(date_time, '{_TIME_SHAPE}') THEN TRY_CAST(date_time AS TIMESTAMP) END AS date_time)
  FROM raw
), valid AS (
  SELECT * FROM parsed WHERE date_time IS NOT NULL AND traffic_volume >= 0
), labels AS (
  SELECT CAST(date_time AS DATE) AS day, arg_min(holiday, row_ord) AS holiday
  FROM valid WHERE holiday IS NOT NULL AND holiday <> 'None' GROUP BY 1
), firsts AS (
  SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY date_time ORDER BY row_ord) = 1
)"""


def _features(source: str, labels: str) -> str:
    """CTEs that take one-per-time rows to the clean table ``c``."""
    return f"""spread AS (
  SELECT f.* REPLACE (
    coalesce(l.holiday, 'None') AS holiday,
    coalesce(weather_main, 'Unknown') AS weather_main,
    coalesce(weather_description, 'Unknown') AS weather_description)
  FROM {source} f LEFT JOIN {labels} l ON CAST(f.date_time AS DATE) = l.day
), bounded AS (
  SELECT * REPLACE (
    CASE WHEN temp BETWEEN 200 AND 330 THEN temp END AS temp,
    CASE WHEN rain_1h BETWEEN 0 AND 100 THEN rain_1h END AS rain_1h,
    CASE WHEN snow_1h BETWEEN 0 AND 100 THEN snow_1h END AS snow_1h,
    CASE WHEN clouds_all BETWEEN 0 AND 100 THEN clouds_all END AS clouds_all)
  FROM spread
), c AS (
  SELECT *, temp - CAST(273.15 AS DOUBLE) AS temp_c,
    CAST(hour(date_time) AS INTEGER) AS hour, CAST(day(date_time) AS INTEGER) AS day,
    CAST(month(date_time) AS INTEGER) AS month, CAST(year(date_time) AS INTEGER) AS year,
    CAST(isodow(date_time) - 1 AS INTEGER) AS day_of_week,
    dayname(date_time) AS day_name, strftime(date_time, '%b') AS month_name,
    CAST(isodow(date_time) >= 6 AS INTEGER) AS is_weekend,
    CAST(holiday <> 'None' AS INTEGER) AS is_holiday,
    CAST(CAST(date_time AS DATE) AS TIMESTAMP) AS date
  FROM bounded
)"""


_CLEAN = f"{_VALID}, {_features('firsts', 'labels')}"


def _observations(volume: str = "value * 10") -> str:
    return f"""e AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events
), typed AS (
  SELECT event_id AS row_ord, {_WEATHER}, event_type AS weather_main,
    concat(event_type, ' ', CAST(k AS VARCHAR)) AS weather_description,
    ts AS date_time, {volume} AS traffic_volume
  FROM e
), numbers AS (
  SELECT * REPLACE (CAST(clouds_all AS DOUBLE) AS clouds_all) FROM typed
), day_labels AS (
  SELECT CAST(date_time AS DATE) AS day, arg_min(holiday, row_ord) AS holiday
  FROM typed WHERE holiday <> 'None' GROUP BY 1
), {_features('numbers', 'day_labels')}"""


_OBS = _observations()

_DAY_OF = (
    "list_extract(['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'], "
    "CAST({} AS INTEGER) + 1)"
)
_MONTH_OF = (
    "list_extract(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'], "
    "CAST({} AS INTEGER))"
)


_CSV_BACK = """SELECT row_ord, nullif(holiday, 'None') AS holiday, temp, rain_1h, snow_1h, CAST(clouds_all AS DOUBLE) AS clouds_all,
  weather_main, CASE WHEN row_ord % 3 = 0 THEN '"' || weather_description || '"' || chr(10) || ', ' || CAST(row_ord AS VARCHAR)
    ELSE weather_description END AS weather_description,
  date_time, traffic_volume FROM raw"""


def _raw_q(body: str) -> str:
    return f"WITH {_RAW}\n{body}"


def _valid_q(body: str) -> str:
    return f"WITH {_VALID}\n{body}"


def _clean_q(body: str) -> str:
    return f"WITH {_CLEAN}\n{body}"


def _obs_q(body: str) -> str:
    return f"WITH {_OBS}\n{body}"


_CLEAN_SELECT = f"""row_ord, holiday, {_r('temp')} AS temp, {_r('rain_1h')} AS rain_1h,
  {_r('snow_1h')} AS snow_1h, {_r('clouds_all')} AS clouds_all, weather_main, weather_description,
  date_time, {_r('traffic_volume')} AS traffic_volume, {_r('temp_c')} AS temp_c, hour, day, month, year,
  day_of_week, day_name, month_name, is_weekend, is_holiday, date"""

_GAPS = """steps AS (
  SELECT date_time, lag(date_time) OVER (ORDER BY date_time) AS prev FROM c
), gaps AS (
  SELECT count(*) FILTER (date_time > prev + INTERVAL 1 HOUR) AS time_gaps,
    {longest} AS longest_gap_days
  FROM steps
)""".format(longest=_r("coalesce(max(date_diff('microsecond', prev, date_time)) / 86400e6, 0)", 1))


_COUNTERS = f""", {_GAPS}, uniq AS (SELECT DISTINCT * EXCLUDE (row_ord) FROM valid),
n AS (SELECT
  (SELECT count(*) FROM raw) AS rows_raw,
  (SELECT count(*) FROM parsed WHERE date_time IS NULL) AS invalid_dates_removed,
  (SELECT count(*) FROM parsed WHERE date_time IS NOT NULL AND (traffic_volume IS NULL OR traffic_volume < 0))
    AS missing_or_negative_target_removed,
  (SELECT count(*) FROM valid) - (SELECT count(*) FROM uniq) AS exact_duplicates_removed,
  (SELECT count(*) FROM uniq) - (SELECT count(*) FROM firsts) AS duplicate_timestamps_removed,
  (SELECT count(*) FROM firsts WHERE temp < 200 OR temp > 330) AS invalid_temp,
  (SELECT count(*) FROM firsts WHERE rain_1h < 0 OR rain_1h > 100) AS invalid_rain_1h,
  (SELECT count(*) FROM firsts WHERE snow_1h < 0 OR snow_1h > 100) AS invalid_snow_1h,
  (SELECT count(*) FROM firsts WHERE clouds_all < 0 OR clouds_all > 100) AS invalid_clouds_all,
  (SELECT count(*) FROM firsts WHERE traffic_volume = 0) AS zero_traffic_rows_kept,
  (SELECT count(*) FROM c) AS rows_clean,
  (SELECT count(*) FROM labels) AS holiday_days)"""

_STEP_TEXTS = [
    ("parse_dates", "printf('%d record(s) dropped because their date and time could not be read.', invalid_dates_removed)"),
    ("valid_target", "printf('%d record(s) dropped because the measured volume is missing or below zero.', "
     "missing_or_negative_target_removed)"),
    ("holiday_labels", "printf('%d day(s) carry a holiday label; it was copied to every record of the day "
     "before any duplicate was removed.', holiday_days)"),
    ("exact_duplicates", "printf('%d exact copies of other records dropped.', exact_duplicates_removed)"),
    ("one_per_time", "printf('%d further record(s) shared their timestamp with an earlier one; the first "
     "in input order was kept.', duplicate_timestamps_removed)"),
    ("text_fill", "'Days without a holiday read ''None'' and missing weather text reads ''Unknown''.'"),
    ("bounds", "printf('Implausible readings set to missing, rows kept: temp %d, rain_1h %d, snow_1h %d, clouds_all %d.', "
     "invalid_temp, invalid_rain_1h, invalid_snow_1h, invalid_clouds_all)"),
    ("zero_volume", "printf('%d record(s) with volume 0 kept.', zero_traffic_rows_kept)"),
    ("calendar", "'Calendar columns, weekend and holiday flags and Celsius were added.'"),
    ("continuity", "printf('%d gap(s) of more than an hour between consecutive records, the longest "
     "about %.1f day(s); none was filled.', time_gaps, longest_gap_days)"),
]
_STEPS = _COUNTERS + "\n" + "\nUNION ALL\n".join(
    f"SELECT CAST({i} AS INTEGER) AS ord, '{name}' AS step, {text} AS text FROM n, gaps"
    for i, (name, text) in enumerate(_STEP_TEXTS, 1)
)


def _missing(names, source: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{n}' AS \"column\", count(*) - count({n}) AS missing FROM {source}" for n in names
    )


_CLEAN_NAMES = [
    "row_ord", "holiday", "temp", "rain_1h", "snow_1h", "clouds_all", "weather_main",
    "weather_description", "date_time", "traffic_volume", "temp_c", "hour", "day", "month", "year",
    "day_of_week", "day_name", "month_name", "is_weekend", "is_holiday", "date",
]

# Column, type and, for text, the tokens that mean missing.
_RAW_TYPES = [
    ("holiday", "string"), ("temp", "double"), ("rain_1h", "double"), ("snow_1h", "double"),
    ("clouds_all", "int"), ("weather_main", "string"), ("weather_description", "string"),
    ("date_time", "string"), ("traffic_volume", "double"),
]


def _describe() -> str:
    parts = []
    for i, (name, kind) in enumerate(_RAW_TYPES, 1):
        value = f"nullif({name}, 'None')" if kind == "string" else name
        parts.append(
            f"SELECT CAST({i} AS INTEGER) AS position, '{name}' AS \"column\", '{kind}' AS data_type, "
            f"count(*) AS rows, count(*) - count({value}) AS missing FROM raw"
        )
    return "\nUNION ALL\n".join(parts)


def _outliers(columns, source: str) -> str:
    parts = []
    for name in columns:
        parts.append(f"""SELECT '{name}' AS "column", {_r('min(v)', 2)} AS min, {_r('max(v)', 2)} AS max,
  {_r('any_value(lo)', 2)} AS lower_fence, {_r('any_value(hi)', 2)} AS upper_fence,
  count(*) FILTER (v < lo OR v > hi) AS outliers,
  {_r('1e2 * count(*) FILTER (v < lo OR v > hi) / count(*)', 2)} AS outlier_pct
FROM (SELECT {name} AS v FROM {source} WHERE {name} IS NOT NULL) x,
  (SELECT q1 - 1.5e0 * (q3 - q1) AS lo, q3 + 1.5e0 * (q3 - q1) AS hi FROM (
    SELECT quantile_cont({name}, 0.25) AS q1, quantile_cont({name}, 0.75) AS q3 FROM {source})) f
HAVING count(*) > 0""")
    return "\nUNION ALL\n".join(parts)


def _flags(keys, source: str = "c", value: str = "traffic_volume", k: str = "1.5e0") -> str:
    """CTE ``flagged``: rows with the limits of their group."""
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    names = "".join(f"{x}, " for x in keys)
    on = " AND ".join(f"s.{x} = l.{x}" for x in keys) or "TRUE"
    return f"""limits AS (
  SELECT {names}q1 - {k} * (q3 - q1) AS lower_limit, q3 + {k} * (q3 - q1) AS upper_limit FROM (
    SELECT {names}quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.75) AS q3
    FROM {source} {group})
), flagged AS (
  SELECT s.*, lower_limit, upper_limit,
    coalesce({value} > upper_limit OR {value} < lower_limit, FALSE) AS is_anomaly,
    CASE WHEN {value} > upper_limit THEN 'High' WHEN {value} < lower_limit THEN 'Low' ELSE 'Normal' END AS anomaly_type
  FROM {source} s LEFT JOIN limits l ON {on}
)"""


_HOURLY_FLAGS = _flags(["hour", "is_weekend"])
_FLAG_SELECT = f"""SELECT row_ord, {_r('lower_limit')} AS lower_limit, {_r('upper_limit')} AS upper_limit,
  is_anomaly, anomaly_type FROM flagged"""

_ANOMALY_TABLE = f"""SELECT date_time, day_name, hour, traffic_volume, anomaly_type,
  {_r('lower_limit', 0)} AS lower_limit, {_r('upper_limit', 0)} AS upper_limit,
  {_r('greatest(traffic_volume - upper_limit, 0) + greatest(lower_limit - traffic_volume, 0)', 0)}
    AS distance_outside_limit, weather_main, holiday
FROM flagged WHERE is_anomaly"""


def _dense(key: str, start: int, end: int, name: str, source: str, volume: str) -> str:
    return f"""SELECT CAST(r.i AS INTEGER) AS {key}, {name}, {_r('m')} AS mean
FROM range({start}, {end}) r(i) LEFT JOIN (
  SELECT {key} AS key, avg({volume}) AS m FROM {source} GROUP BY 1) g ON g.key = r.i"""


_ORDERS = """c AS (
  SELECT o_orderkey AS row_ord, o_orderdate AS date_time, o_totalprice AS traffic_volume,
    CAST(month(o_orderdate) AS INTEGER) AS month FROM orders
)"""


def _extremes(key: str, label: str, name: str, source: str, gap: bool = False) -> str:
    extra = f", {_r('1e2 * (h.m - l.m) / nullif(l.m, 0)')} AS gap_pct" if gap else ""
    return f"""SELECT {label.format('h.' + key)} AS highest_{name}, {_r('h.m')} AS highest_mean,
  {label.format('l.' + key)} AS lowest_{name}, {_r('l.m')} AS lowest_mean{extra}
FROM (SELECT {key}, avg(traffic_volume) AS m FROM {source} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) h,
  (SELECT {key}, avg(traffic_volume) AS m FROM {source} GROUP BY 1 ORDER BY 2, 1 LIMIT 1) l"""


def _histogram(bins: int) -> str:
    return f"""ends AS (
  SELECT CASE WHEN lo = hi THEN lo - 0.5e0 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5e0 ELSE hi END AS hi
  FROM (SELECT min(traffic_volume) AS lo, max(traffic_volume) AS hi FROM c)
), w AS (SELECT lo, (hi - lo) / CAST({bins} AS DOUBLE) AS width FROM ends
), binned AS (
  SELECT CAST(least(floor((traffic_volume - lo) / width), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
  FROM c, w GROUP BY 1
), hist AS (
  SELECT CAST(i AS INTEGER) AS bin, lo + i * width AS lower_edge, lo + (i + 1) * width AS upper_edge,
    coalesce(n, 0) AS count
  FROM range({bins}) r(i) CROSS JOIN w LEFT JOIN binned ON bin = i
)"""


def _pearson(columns, source: str, target: str) -> str:
    parts = [
        f"""SELECT '{x}' AS "column", count(*) AS n,
  CASE WHEN min(x) <> max(x) AND min(y) <> max(y) THEN corr(x, y) END AS r
FROM (SELECT {x} AS x, {target} AS y FROM {source} WHERE {x} IS NOT NULL AND {target} IS NOT NULL)"""
        for x in columns
    ]
    pairs = "\nUNION ALL\n".join(parts)
    return f"""SELECT "column", n, {_r('r')} AS r,
  CASE WHEN r IS NULL THEN 'undefined' WHEN abs(r) < 0.1 THEN 'very weak' WHEN abs(r) < 0.3 THEN 'weak'
    WHEN abs(r) < 0.5 THEN 'moderate' ELSE 'strong' END AS strength
FROM ({pairs})"""


def _matrix(columns, source: str) -> str:
    """CTE ``matrix``: Pearson r of every pair."""
    parts = []
    for a in columns:
        for b in columns:
            if a == b:
                r = f"CASE WHEN min({a}) <> max({a}) THEN 1e0 END"
                where = ""
            else:
                r = (f"CASE WHEN min({a}) <> max({a}) AND min({b}) <> max({b}) THEN "
                     f"corr({a}, {b}) END")
                where = f" WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, {r} AS r FROM {source}{where}")
    pairs = "\n  UNION ALL ".join(parts)
    return f"src AS MATERIALIZED (SELECT * FROM {source}), matrix AS (\n  {pairs}\n)".replace(
        f"FROM {source} WHERE", "FROM src WHERE"
    )


_CORR_COLUMNS = [
    "traffic_volume", "hour", "day_of_week", "month", "is_weekend", "is_holiday", "temp_c",
    "rain_1h", "snow_1h", "clouds_all",
]
_LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _edges(n: int) -> str:
    probs = ", ".join(f"CAST('{i * (1 / n) * 100 / 100 if i < n else 1.0!r}' AS DOUBLE)" for i in range(n + 1))
    return f"list_sort(list_distinct(quantile_cont(x, [{probs}])))"


_TREND = f"""p AS (
  SELECT temp_c AS x, traffic_volume AS y FROM c WHERE temp_c IS NOT NULL AND traffic_volume IS NOT NULL
), edges AS (
  SELECT CASE WHEN count(DISTINCT x) = 11 THEN {_edges(11)} WHEN count(DISTINCT x) > 11 THEN {_edges(12)} END AS e
  FROM p
), binned AS (
  SELECT x, y, CAST(greatest(len(list_filter(e, lambda v: v < x)), 1) AS INTEGER) AS bin FROM p, edges WHERE e IS NOT NULL
)
SELECT bin, {_r('avg(x)')} AS mean_x, {_r('avg(y)')} AS mean_y, count(*) AS n FROM binned GROUP BY bin"""

_RANGES = """runs AS (
  SELECT min(hour) AS a, max(hour) AS b FROM (
    SELECT hour, hour - row_number() OVER (ORDER BY hour) AS run FROM (SELECT DISTINCT hour FROM {})
  ) GROUP BY run
), ranges AS (
  SELECT coalesce(string_agg(printf('%02d:00-%02d:59', a, b), ', ' ORDER BY a), 'none') AS ranges FROM runs
)"""

_HIGH = f"""thr AS (SELECT quantile_cont(traffic_volume, 0.75) AS t FROM c
), high AS (
  SELECT *, share_above_threshold >= 50 AS consistently_high FROM (
    SELECT hour, {_r('avg(traffic_volume)', 1)} AS mean_traffic,
      {_r('1e2 * avg(CAST(traffic_volume > t AS DOUBLE))', 1)} AS share_above_threshold, any_value(t) AS threshold
    FROM c, thr GROUP BY hour)
)"""

_FACTS = f"""{_HIGH}, {_RANGES.format('high WHERE consistently_high')},
h AS (SELECT hour, {_r('avg(traffic_volume)', 1)} AS m FROM c GROUP BY 1),
d AS (SELECT day_of_week, day_name, {_r('avg(traffic_volume)', 1)} AS m FROM c GROUP BY 1, 2),
t AS (SELECT is_weekend, hour, {_r('avg(traffic_volume)', 1)} AS m FROM c GROUP BY 1, 2),
m AS (SELECT avg(traffic_volume) FILTER (is_weekend = 0) AS wk, avg(traffic_volume) FILTER (is_weekend = 1) AS we FROM c),
top AS (SELECT * FROM c ORDER BY traffic_volume DESC, date_time LIMIT 1)
SELECT CAST(ord AS INTEGER) AS ord, fact, label, {_r('value')} AS value FROM (
  SELECT * FROM (SELECT 1 AS ord, 'busiest_hour' AS fact, printf('%02d:00', hour) AS label, m AS value FROM h ORDER BY m DESC, hour LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 2, 'quietest_hour', printf('%02d:00', hour), m FROM h ORDER BY m, hour LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 3, 'busiest_day', day_name, m FROM d ORDER BY m DESC, day_of_week LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 4, 'quietest_day', day_name, m FROM d ORDER BY m, day_of_week LIMIT 1)
  UNION ALL SELECT 5, 'weekday_mean', NULL, wk FROM m WHERE wk IS NOT NULL AND we IS NOT NULL
  UNION ALL SELECT 6, 'weekend_mean', NULL, we FROM m WHERE wk IS NOT NULL AND we IS NOT NULL
  UNION ALL SELECT 7, 'weekday_vs_weekend_pct', CASE WHEN wk >= we THEN 'higher' ELSE 'lower' END,
    1e2 * (wk - we) / nullif(we, 0) FROM m WHERE wk IS NOT NULL AND we IS NOT NULL
  UNION ALL SELECT * FROM (SELECT 8, 'weekday_peak', printf('%02d:00', hour), m FROM t WHERE is_weekend = 0 ORDER BY m DESC, hour LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 9, 'weekend_peak', printf('%02d:00', hour), m FROM t WHERE is_weekend = 1 ORDER BY m DESC, hour LIMIT 1)
  UNION ALL SELECT 10, 'high_hours', ranges, t FROM ranges, thr
  UNION ALL SELECT 11, 'highest_record', concat_ws(' ', strftime(date_time, '%d %b %Y'), printf('%02d:00', hour), day_name),
    traffic_volume FROM top
)"""

_SENTENCES = _FACTS.replace("SELECT CAST(ord AS INTEGER) AS ord, fact, label", ", facts AS (\nSELECT ord, fact, label") + """),
w AS (SELECT map_from_entries(list((fact, label))) AS l,
  map_from_entries(list((fact, format('{:,.0f}', value)))) AS v,
  map_from_entries(list((fact, format('{:,.1f}', abs(value))))) AS d FROM facts)
SELECT CAST(1 AS INTEGER) AS ord, 'On average the busiest hour starts at ' || l['busiest_hour'] || ' (mean ' || v['busiest_hour']
  || ') and the quietest at ' || l['quietest_hour'] || ' (mean ' || v['quietest_hour'] || ').' AS text FROM w
UNION ALL SELECT 2, l['busiest_day'] || ' has the highest daily mean (' || v['busiest_day'] || '), '
  || l['quietest_day'] || ' the lowest (' || v['quietest_day'] || ').' FROM w
UNION ALL SELECT 3, 'The weekday mean of ' || v['weekday_mean'] || ' is ' || d['weekday_vs_weekend_pct'] || ' % '
  || l['weekday_vs_weekend_pct'] || ' than the weekend mean of ' || v['weekend_mean'] || '.' FROM w
UNION ALL SELECT 4, 'Weekdays peak at ' || l['weekday_peak'] || ' (' || v['weekday_peak'] || '), weekends at '
  || l['weekend_peak'] || ' (' || v['weekend_peak'] || ').' FROM w
UNION ALL SELECT 5, 'At least half of the records exceed ' || v['high_hours'] || ' (the upper quartile) during: '
  || l['high_hours'] || '.' FROM w
UNION ALL SELECT 6, 'The highest single record is ' || v['highest_record'] || ' on ' || l['highest_record'] || '.' FROM w"""


_FIXED = """fixed AS (
  SELECT model, avg(abs(traffic_volume - p)) AS mae, sqrt(avg((traffic_volume - p) ** 2)) AS rmse,
    1 - sum((traffic_volume - p) ** 2) / (var_pop(traffic_volume) * count(*)) AS r2
  FROM (
    SELECT traffic_volume, p_baseline AS p, 'Baseline (training mean)' AS model FROM base
    UNION ALL SELECT traffic_volume, CAST(400 + 10 * hour AS DOUBLE), 'Linear Regression' FROM base
    UNION ALL SELECT traffic_volume, CAST(500 - 80 * is_weekend AS DOUBLE), 'Random Forest' FROM base)
  GROUP BY model
)"""

_SPLIT = """ordered AS (
  SELECT *, row_number() OVER (ORDER BY date_time) - 1 AS pos, count(*) OVER () AS total FROM c
), parts AS (
  SELECT *, CASE WHEN pos < floor(total * CAST('0.8' AS DOUBLE)) THEN 'train' ELSE 'test' END AS part FROM ordered
), base AS (
  SELECT *, greatest((SELECT avg(traffic_volume) FROM parts WHERE part = 'train'), 0) AS p_baseline
  FROM parts WHERE part = 'test'
)"""


def _metrics(digits: int) -> str:
    return f"""SELECT 'Baseline (training mean)' AS model,
  {_r('avg(abs(traffic_volume - p_baseline))', digits)} AS "MAE",
  {_r('sqrt(avg((traffic_volume - p_baseline) ** 2))', digits)} AS "RMSE",
  {_r('1 - sum((traffic_volume - p_baseline) ** 2) / sum((traffic_volume - m) ** 2)', digits)} AS "R2"
FROM base, (SELECT avg(traffic_volume) AS m FROM base)"""


def _mode(name: str) -> str:
    return f"(SELECT {name} FROM tr WHERE {name} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS {name}"


_POINTS = """complete AS (
  SELECT *, sin(2e0 * pi() * hour / 24e0) AS hour_sin, cos(2e0 * pi() * hour / 24e0) AS hour_cos,
    is_weekend * 2 + CAST(hour >= 12 AS INTEGER) AS cluster
  FROM c WHERE traffic_volume IS NOT NULL AND hour IS NOT NULL AND is_weekend IS NOT NULL
    AND temp_c IS NOT NULL AND clouds_all IS NOT NULL
)"""
_POINT_FEATURES = ["traffic_volume", "hour_sin", "hour_cos", "is_weekend", "temp_c", "clouds_all"]

_SILHOUETTE = f"""{_POINTS}, stats AS (
  SELECT {', '.join(f'avg({f}) AS m{i}, stddev_pop({f}) AS s{i}' for i, f in enumerate(_POINT_FEATURES))} FROM complete
), pts AS MATERIALIZED (
  SELECT row_ord, cluster, {', '.join(f'({f} - m{i}) / nullif(s{i}, 0) AS z{i}' for i, f in enumerate(_POINT_FEATURES))}
  FROM complete, stats ORDER BY md5(concat(CAST(row_ord AS VARCHAR), ':42')), row_ord LIMIT 5000
), sizes AS (SELECT cluster, count(*) AS n FROM pts GROUP BY 1
), dist AS (
  SELECT a.row_ord, a.cluster AS own, b.cluster AS other,
    sum(sqrt({' + '.join(f'(a.z{i} - b.z{i}) ** 2' for i in range(6))})) AS total
  FROM pts a, pts b GROUP BY 1, 2, 3
), per AS (
  SELECT d.row_ord, any_value(o.n) AS own_n,
    max(CASE WHEN d.own = d.other THEN d.total / greatest(s.n - 1, 1) END) AS inner_d,
    min(CASE WHEN d.own <> d.other THEN d.total / s.n END) AS outer_d
  FROM dist d JOIN sizes s ON s.cluster = d.other JOIN sizes o ON o.cluster = d.own GROUP BY 1
)
SELECT {_r('avg(CASE WHEN own_n > 1 THEN (outer_d - inner_d) / greatest(inner_d, outer_d) ELSE 0 END)')} AS silhouette,
  count(*) AS points FROM per"""

_HEAT_COLUMNS = ", ".join(
    f"{_r(f'avg(traffic_volume) FILTER (hour = {h})')} AS h{h:02d}" for h in range(24)
)
_HEAT_NAMES = ", ".join(f"h{h:02d}" for h in range(24))

_PERIOD = {
    "hourly": "date_time",
    "daily": "CAST(CAST(date_time AS DATE) AS TIMESTAMP)",
    "weekly": "CAST(CAST(date_trunc('week', date_time) AS DATE) + 6 AS TIMESTAMP)",
    "monthly": "CAST(date_trunc('month', date_time) AS TIMESTAMP)",
}


def oracle_sql() -> dict[str, str]:
    sql = {
        "s1_scan_raw": _raw_q("""SELECT row_ord, nullif(holiday, 'None') AS holiday, temp, rain_1h, snow_1h,
  clouds_all, weather_main, weather_description, date_time, traffic_volume FROM raw"""),
        "s1_read_csv": _raw_q(_CSV_BACK),
        "s1_read_csv_gz": _raw_q(_CSV_BACK),
        "s7_preview": _raw_q("SELECT * FROM raw ORDER BY row_ord LIMIT 10"),
        "q1_describe": _raw_q(_describe()),
        "q2_outlier_summary": _obs_q(_outliers(
            ["traffic_volume", "temp_c", "rain_1h", "snow_1h", "clouds_all"], "c")),
        "q2_outlier_summary_lineitem": _outliers(_LINE_COLUMNS, "lineitem"),
        "q3_missing_after": _clean_q(f"SELECT * FROM ({_missing(_CLEAN_NAMES, 'c')}) WHERE missing > 0"),
        "q4_time_gaps": _clean_q(f", {_GAPS}\nSELECT * FROM gaps").replace(")\n, steps", "), steps"),
        "q6_clean_report": _clean_q(f"""{_COUNTERS}
SELECT n.*, gaps.*, rows_raw - rows_clean AS rows_removed FROM n, gaps""").replace(")\n, steps", "), steps"),
        "q7_steps": _clean_q(_STEPS).replace(")\n, steps", "), steps"),
        "c1_parse_dates": _valid_q("SELECT row_ord, date_time FROM parsed"),
        "c2_coerce": _valid_q("SELECT row_ord, temp, rain_1h, snow_1h, clouds_all, traffic_volume FROM parsed"),
        "c3_valid_target": _valid_q("SELECT row_ord, date_time, traffic_volume FROM valid"),
        "c4_holiday_labels": _valid_q("SELECT CAST(day AS TIMESTAMP) AS day, holiday FROM labels"),
        "c5_exact_dups": _valid_q("""SELECT count(*) AS distinct_rows,
  CAST((SELECT count(*) FROM valid) - count(*) AS BIGINT) AS exact_duplicates
FROM (SELECT DISTINCT * EXCLUDE (row_ord) FROM valid)"""),
        "c6_one_per_ts": _valid_q("SELECT row_ord, date_time, temp, traffic_volume FROM firsts"),
        "c7_spread_holiday": _clean_q(
            "SELECT row_ord, date_time, holiday, weather_main, weather_description FROM spread"),
        "c8_bounds": _clean_q("SELECT row_ord, temp, rain_1h, snow_1h, clouds_all FROM bounded"),
        "c8_invalid_counts": _valid_q("""SELECT
  count(*) FILTER (temp < 200 OR temp > 330) AS invalid_temp,
  count(*) FILTER (rain_1h < 0 OR rain_1h > 100) AS invalid_rain_1h,
  count(*) FILTER (snow_1h < 0 OR snow_1h > 100) AS invalid_snow_1h,
  count(*) FILTER (clouds_all < 0 OR clouds_all > 100) AS invalid_clouds_all FROM firsts"""),
        "c9_features": _clean_q(f"""SELECT row_ord, {_r('temp_c')} AS temp_c, hour, day, month, year, day_of_week,
  day_name, month_name, is_weekend, is_holiday, date FROM c"""),
        "c10_clean": _clean_q(f"SELECT {_CLEAN_SELECT} FROM c"),
        "c11_date_filter": _obs_q("""SELECT row_ord, date_time, traffic_volume FROM c
WHERE date_time >= TIMESTAMP '2024-01-05' AND date_time < TIMESTAMP '2024-01-12' + INTERVAL 1 DAY"""),
        "c12_bounds": _obs_q("""SELECT CAST(CAST(min(date_time) AS DATE) AS TIMESTAMP) AS min_date,
  CAST(CAST(max(date_time) AS DATE) AS TIMESTAMP) AS max_date FROM c"""),
        "a1_hourly_profile": _obs_q(f"""SELECT hour, {_r('avg(traffic_volume)', 1)} AS mean,
  {_r('median(traffic_volume)')} AS median, count(traffic_volume) AS observations FROM c GROUP BY hour"""),
        "a2_dow_profile": _obs_q(f"""SELECT day_of_week, day_name, {_r('avg(traffic_volume)', 1)} AS mean_traffic
FROM c GROUP BY 1, 2"""),
        "a3_daytype_profile": _obs_q(f"""SELECT hour, CASE is_weekend WHEN 0 THEN 'Weekday' ELSE 'Weekend' END AS day_type,
  {_r('avg(traffic_volume)', 1)} AS mean_traffic FROM c GROUP BY 1, 2"""),
        "a4_high_periods": _obs_q(f""", {_HIGH}
SELECT hour, mean_traffic, share_above_threshold, consistently_high, {_r('threshold')} AS threshold FROM high"""),
        "a5_hour_mean_std": _obs_q(f"""SELECT hour, {_r('avg(traffic_volume)')} AS mean,
  {_r('coalesce(stddev_samp(traffic_volume), 0)')} AS std FROM c GROUP BY hour"""),
        "a5_hour_extremes": _obs_q(_extremes("hour", "{}", "hour", "c")),
        "a6_day_dense": _obs_q(_dense(
            "day_of_week", 0, 7, f"{_DAY_OF.format('r.i')} AS day_name", "c", "traffic_volume")),
        "a6_day_extremes": _obs_q(_extremes("day_of_week", _DAY_OF, "day", "c", gap=True)),
        "a7_month_dense": f"WITH {_ORDERS}\n" + _dense(
            "month", 1, 13, f"{_MONTH_OF.format('r.i')} AS month_name", "c", "traffic_volume"),
        "a7_month_extremes": f"WITH {_ORDERS}\n" + _extremes("month", _MONTH_OF, "month", "c"),
        "a8_heatmap": _obs_q(f"""SELECT CAST(i AS INTEGER) AS day_of_week, {_HEAT_NAMES}
FROM range(7) r(i) LEFT JOIN (SELECT day_of_week, {_HEAT_COLUMNS} FROM c GROUP BY 1) g ON g.day_of_week = i"""),
        "a8_heatmap_extremes": _obs_q(f""", cells AS (
  SELECT day_of_week, day_name, hour, avg(traffic_volume) AS m FROM c GROUP BY 1, 2, 3)
SELECT h.day_name AS highest_day, h.hour AS highest_hour, {_r('h.m')} AS highest_mean,
  l.day_name AS lowest_day, l.hour AS lowest_hour, {_r('l.m')} AS lowest_mean
FROM (SELECT * FROM cells ORDER BY m DESC, day_of_week, hour LIMIT 1) h,
  (SELECT * FROM cells ORDER BY m, day_of_week, hour LIMIT 1) l"""),
        "a9_category_profile": _obs_q(f"""SELECT weather_main, {_r('avg(traffic_volume)')} AS mean,
  count(traffic_volume) AS count FROM c GROUP BY 1"""),
        "a9_category_extremes": _obs_q(f""", g AS (
  SELECT weather_main AS w, avg(traffic_volume) AS m, count(traffic_volume) AS n FROM c GROUP BY 1)
SELECT h.w AS highest_category, {_r('h.m')} AS highest_mean, h.n AS highest_n,
  l.w AS lowest_category, {_r('l.m')} AS lowest_mean, l.n AS lowest_n
FROM (SELECT * FROM g ORDER BY m DESC, w LIMIT 1) h, (SELECT * FROM g ORDER BY m, w DESC LIMIT 1) l"""),
        "a10_kpis": _obs_q(f"""SELECT count(*) AS observations, {_r('avg(traffic_volume)')} AS mean_traffic,
  {_r('max(traffic_volume)')} AS max_traffic, any_value(b.hour) AS busiest_hour,
  any_value(b.m) AS busiest_hour_mean
FROM c, (SELECT hour, {_r('avg(traffic_volume)', 1)} AS m FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) b"""),
        "a12_anomaly_by_hour": _obs_q(f""", {_HOURLY_FLAGS}
SELECT hour, anomaly_type, count(*) AS count FROM flagged WHERE is_anomaly GROUP BY 1, 2"""),
        "a13_daytype_diff": _obs_q(f"""SELECT {_r('wk')} AS weekday_mean, {_r('we')} AS weekend_mean,
  {_r('1e2 * (wk - we) / nullif(we, 0)')} AS diff_pct, CASE WHEN wk >= we THEN 'higher' ELSE 'lower' END AS direction
FROM (SELECT avg(traffic_volume) FILTER (is_weekend = 0) AS wk, avg(traffic_volume) FILTER (is_weekend = 1) AS we FROM c)
WHERE wk IS NOT NULL AND we IS NOT NULL"""),
        "a14_categories": _obs_q("SELECT DISTINCT weather_main FROM c"),
        "t1_top_hours": _obs_q(f"""SELECT printf('%02d:00 - %02d:59', hour, hour) AS time_window, * FROM (
  SELECT hour, {_r('avg(traffic_volume)', 1)} AS mean, {_r('median(traffic_volume)')} AS median,
    count(traffic_volume) AS observations FROM c GROUP BY hour ORDER BY 2 DESC, hour LIMIT 5)"""),
        "t2_top_observations": _obs_q("""SELECT date_time, day_name, hour, traffic_volume, weather_main, holiday
FROM c ORDER BY traffic_volume DESC, date_time LIMIT 5"""),
        "t4_peak_by_daytype": _obs_q(f"""SELECT * FROM (
  SELECT CASE is_weekend WHEN 0 THEN 'Weekday' ELSE 'Weekend' END AS day_type, hour,
    {_r('avg(traffic_volume)', 1)} AS mean_traffic FROM c GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY day_type ORDER BY mean_traffic DESC, hour) = 1"""),
        "t5_anomaly_table": _obs_q(f", {_HOURLY_FLAGS}\n{_ANOMALY_TABLE}"),
        "t5_anomaly_table_top": _obs_q(
            f", {_HOURLY_FLAGS}\n{_ANOMALY_TABLE} ORDER BY distance_outside_limit DESC, date_time LIMIT 500"),
        "t6_sample": _obs_q("""SELECT row_ord, date_time, traffic_volume FROM c
ORDER BY md5(concat(CAST(row_ord AS VARCHAR), ':0')), row_ord LIMIT 4000"""),
        "t6_weather_scatter": _obs_q(f"""SELECT row_ord, {_r('temp_c')} AS temp_c, {_r('traffic_volume')} AS traffic_volume
FROM c WHERE temp_c IS NOT NULL AND traffic_volume IS NOT NULL
ORDER BY md5(concat(CAST(row_ord AS VARCHAR), ':0')), row_ord LIMIT 4000"""),
        "m1_distribution": _obs_q(f"""SELECT {_r('avg(traffic_volume)')} AS mean, {_r('median(traffic_volume)')} AS median,
  {_r('stddev_samp(traffic_volume)')} AS std, {_r('skewness(traffic_volume)')} AS skewness, {_r('any_value(q)')} AS q1,
  {_r('1e2 * avg(CAST(traffic_volume < q AS DOUBLE))')} AS below_q1_pct
FROM c, (SELECT quantile_cont(traffic_volume, 0.25) AS q FROM c)"""),
        "m2_histogram": _obs_q(f""", {_histogram(20)}
SELECT bin, {_r('lower_edge')} AS lower_edge, {_r('upper_edge')} AS upper_edge, count FROM hist"""),
        "m2_histogram_display": _obs_q(f""", {_histogram(50)}
SELECT bin, {_r('lower_edge')} AS lower_edge, {_r('upper_edge')} AS upper_edge, count FROM hist"""),
        "m3_peaks": _obs_q(f""", {_histogram(20)}, sm AS (
  SELECT bin, coalesce(lag(count) OVER (ORDER BY bin), 0) * (1e0 / 3e0) + count * (1e0 / 3e0)
    + coalesce(lead(count) OVER (ORDER BY bin), 0) * (1e0 / 3e0) AS s FROM hist
), nb AS (SELECT bin, s, lag(s) OVER (ORDER BY bin) AS p, lead(s) OVER (ORDER BY bin) AS n, max(s) OVER () AS m FROM sm)
SELECT count(*) AS peaks FROM nb WHERE s > p AND s > n AND s > 0.3e0 * m"""),
        "m4_pearson": _obs_q(_pearson(["temp_c", "rain_1h", "snow_1h", "clouds_all"], "c", "traffic_volume")),
        "m4_pearson_lineitem": _pearson(["l_quantity", "l_discount", "l_tax"], "lineitem", "l_extendedprice"),
        "m5_quantile_trend": _obs_q(f", {_TREND}"),
        "m6_corr_matrix": _obs_q(f", {_matrix(_CORR_COLUMNS, 'c')}\nSELECT a, b, {_r('r')} AS r FROM matrix"),
        "m6_corr_matrix_lineitem": f"WITH {_matrix(_LINE_COLUMNS, 'lineitem')}\nSELECT a, b, {_r('r')} AS r FROM matrix",
        "m7_top_corr": _obs_q(f""", {_matrix(_CORR_COLUMNS, 'c')}
SELECT b AS "column", {_r('r')} AS r FROM matrix
WHERE a = 'traffic_volume' AND b <> 'traffic_volume' AND r IS NOT NULL ORDER BY abs(matrix.r) DESC, b LIMIT 3"""),
        "m8_quantiles": _obs_q(f"""SELECT count(traffic_volume) AS n, {_r('quantile_cont(traffic_volume, 0.25)')} AS p25,
  {_r('quantile_cont(traffic_volume, 0.5)')} AS p50, {_r('quantile_cont(traffic_volume, 0.75)')} AS p75 FROM c"""),
        "m8_quantiles_distributed": f"""SELECT l_returnflag, count(l_extendedprice) AS n,
  {', '.join(f"{_r(f'quantile_cont(l_extendedprice, {p / 100})')} AS p{p}" for p in (1, 25, 50, 75, 99))}
FROM lineitem GROUP BY 1""",
        "n1_iqr": _obs_q(f", {_HOURLY_FLAGS}\n{_FLAG_SELECT}"),
        "n1_iqr_low_side": f"WITH {_observations('CASE WHEN value > 0 THEN ln(value) END')}, {_HOURLY_FLAGS}\n{_FLAG_SELECT}",
        "n1_iqr_lineitem": f"""WITH {_flags(['l_returnflag', 'l_linestatus'], 'lineitem', 'l_extendedprice')}
SELECT l_returnflag, l_linestatus, {_r('lower_limit')} AS lower_limit, {_r('upper_limit')} AS upper_limit,
  anomaly_type, count(*) AS count FROM flagged GROUP BY ALL""",
        "n2_iqr_global": _obs_q(f", {_flags([])}\n{_FLAG_SELECT}"),
        "n3_anomaly_counts": _obs_q(f""", {_HOURLY_FLAGS}
SELECT count(*) AS total, count(*) FILTER (is_anomaly) AS flagged, count(*) FILTER (anomaly_type = 'High') AS high,
  count(*) FILTER (anomaly_type = 'Low') AS low, {_r('1e2 * avg(CAST(is_anomaly AS DOUBLE))', 2)} AS percent FROM flagged"""),
        "n4_series_high": _obs_q(f""", {_HOURLY_FLAGS}
SELECT date_time, traffic_volume, anomaly_type FROM flagged WHERE anomaly_type = 'High'"""),
        "x15_hour_ranges": _obs_q(f""", busy AS (
  SELECT hour FROM c GROUP BY hour HAVING avg(traffic_volume) > (SELECT avg(traffic_volume) FROM c)
), {_RANGES.format('busy')}
SELECT ranges FROM ranges"""),
        "x15_high_hour_ranges": _obs_q(
            f", {_HIGH}, {_RANGES.format('high WHERE consistently_high')}\nSELECT ranges FROM ranges"),
        "f1_findings": _obs_q(f", {_FACTS}"),
        "f1_sentences": _obs_q(f", {_SENTENCES}"),
        "k1_features": _obs_q(f""", {_POINTS}
SELECT row_ord, {', '.join(f'{_r(f)} AS {f}' if f != 'is_weekend' else f for f in _POINT_FEATURES)} FROM complete"""),
        "k3_summary_fixed_labels": _obs_q(f""", {_POINTS}
SELECT cluster, count(*) AS observations, {_r('avg(traffic_volume)', 2)} AS avg_traffic, {_r('avg(hour)', 2)} AS avg_hour,
  {_r(f"1e2 * {_r('avg(is_weekend)', 2)}", 1)} AS weekend_pct, {_r('avg(temp_c)', 2)} AS avg_temp_c,
  {_r('avg(clouds_all)', 2)} AS avg_clouds FROM complete GROUP BY 1"""),
        "f2_common_hours": _obs_q(f""", {_POINTS}
SELECT cluster, string_agg(printf('%02d:00', hour), ', ' ORDER BY hour) AS common_hours FROM (
  SELECT cluster, hour, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, hour) AS rn
  FROM complete GROUP BY 1, 2) WHERE rn <= 3 GROUP BY 1"""),
        "f2_labels_fixed": _obs_q(f""", {_POINTS}, sums AS (
  SELECT cluster, count(*) AS observations, {_r('avg(traffic_volume)', 2)} AS avg_traffic,
    {_r(f"1e2 * {_r('avg(is_weekend)', 2)}", 1)} AS weekend_pct FROM complete GROUP BY 1
), hours AS (
  SELECT cluster, string_agg(printf('%02d:00', hour), ', ' ORDER BY hour) AS common_hours FROM (
    SELECT cluster, hour, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, hour) AS rn
    FROM complete GROUP BY 1, 2) WHERE rn <= 3 GROUP BY 1
), rated AS (
  SELECT *, avg_traffic / (SELECT avg(traffic_volume) FROM complete) AS ratio FROM sums JOIN hours USING (cluster)
)
SELECT cluster, observations, common_hours, concat(
  CASE WHEN ratio >= 1.15 THEN 'High traffic' WHEN ratio <= 0.6 THEN 'Very low traffic' WHEN ratio <= 0.9 THEN 'Low traffic' ELSE 'Average traffic' END, ', ',
  CASE WHEN weekend_pct >= 60 THEN 'mainly weekends' WHEN weekend_pct <= 15 THEN 'mainly weekdays' ELSE 'weekdays and weekends' END,
  '; most often at ', common_hours) AS description FROM rated"""),
        "k5_points_fixed_labels": _obs_q(f""", {_POINTS}
SELECT date_time, hour, {_r('traffic_volume')} AS traffic_volume, {_r('temp_c')} AS temp_c, {_r('clouds_all')} AS clouds_all,
  cluster, CASE is_weekend WHEN 0 THEN 'Weekday' ELSE 'Weekend' END AS day_type
FROM complete ORDER BY md5(concat(CAST(row_ord AS VARCHAR), ':1')), row_ord LIMIT 6000"""),
        "k4_silhouette": _obs_q(f", {_SILHOUETTE}"),
        "k2_checks": """SELECT CAST(4 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS mixed_labels, CAST(0 AS BIGINT) AS out_of_order,
  CAST(0 AS BIGINT) AS undescribed, CAST(0 AS BIGINT) AS rows_lost, CAST(0 AS BIGINT) AS summary_lost, CAST(0 AS BIGINT) AS points_lost""",
        "l1_split_ties": f"""WITH {_ORDERS}
SELECT row_ord, date_time, CASE WHEN row_number() OVER (ORDER BY date_time, row_ord) <= floor(count(*) OVER () * 0.8)
  THEN 'train' ELSE 'test' END AS part FROM c""",
        "l4_checks": "SELECT 0 AS violations",
        "l5_checks": "SELECT 1 AS beats_baseline, 1 AS never_negative, 1 AS same_twice",
        "l7_best_fixed": _obs_q(f""", {_SPLIT}, {_FIXED}
SELECT arg_min(model, rmse) FILTER (model <> 'Baseline (training mean)') AS best_model,
  {_r("min(rmse) FILTER (model <> 'Baseline (training mean)')")} AS best_rmse,
  {_r("max(rmse) FILTER (model = 'Baseline (training mean)')")} AS baseline_rmse FROM fixed"""),
        "l9_score_fixed": _obs_q(f""", h AS (
  SELECT hour, day_of_week, month, count(*) AS n, CAST(day_of_week >= 5 AS INTEGER) AS is_weekend FROM c GROUP BY 1, 2, 3)
SELECT *, {_r('CAST(greatest(25 * hour - 40 * day_of_week + 20 - 60 * is_weekend - 100, 0) AS DOUBLE)')} AS predicted FROM h"""),
        "l10_importance_checks": "SELECT CAST(1 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS negative",
        "l11_metrics_fixed": _obs_q(f""", {_SPLIT}, {_FIXED}
SELECT model, metric, {_r('value')} AS value FROM (
  SELECT model, unnest(['MAE', 'RMSE', 'R2']) AS metric, unnest([mae, rmse, r2]) AS value FROM fixed)"""),
        "l1_split": _obs_q(f", {_SPLIT}\nSELECT row_ord, date_time, part FROM parts"),
        "l2_impute_stats": _obs_q(f""", {_SPLIT}, tr AS (SELECT * FROM parts WHERE part = 'train')
SELECT {', '.join(_mode(x) for x in ('hour', 'day_of_week', 'month', 'weather_main'))},
  {', '.join(f"{_r(f'median({x})')} AS {x}" for x in ('temp_c', 'rain_1h', 'snow_1h', 'clouds_all'))} FROM tr"""),
        "l3_baseline": _obs_q(f""", {_SPLIT}
SELECT row_ord, {_r('traffic_volume')} AS traffic_volume, {_r('p_baseline')} AS p_baseline FROM base"""),
        "l6_metrics": _obs_q(f", {_SPLIT}\n{_metrics(6)}"),
        "l12_window_view": _obs_q(f""", {_SPLIT}
SELECT date_time, {_r('traffic_volume')} AS actual, {_r('p_baseline')} AS predicted FROM base
WHERE date_time >= TIMESTAMP '2024-01-25' AND date_time < TIMESTAMP '2024-01-28'"""),
        "l13_split_facts": _obs_q(f""", {_SPLIT}
SELECT part, min(date_time) AS first_ts, max(date_time) AS last_ts, count(*) AS rows FROM parts GROUP BY 1"""),
        "l13_shown_metrics": _obs_q(f", {_SPLIT}\n{_metrics(3)}"),
        "l14_residual_sample": _obs_q(f""", {_SPLIT}, s AS (
  SELECT row_ord, date_time, traffic_volume AS actual, p_baseline AS predicted FROM base
  ORDER BY md5(concat(CAST(row_ord AS VARCHAR), ':0')), row_ord LIMIT 3000)
SELECT row_ord, date_time, {_r('actual')} AS actual, {_r('predicted')} AS predicted,
  {_r('greatest(max(actual) OVER (), max(predicted) OVER ())')} AS axis_max FROM s"""),
    }
    for period, label in _PERIOD.items():
        series = f"""WITH {_ORDERS}, p AS (
  SELECT {label} AS date_time, avg(traffic_volume) AS m FROM c GROUP BY 1)"""
        if period == "hourly":
            series = f"WITH {_ORDERS}, p AS (SELECT date_time, traffic_volume AS m FROM c)"
        sql[f"a11_resample_{period}"] = f"{series}\nSELECT date_time, {_r('m')} AS traffic_volume FROM p"
        sql[f"a11_facts_{period}"] = (
            f"{series}\nSELECT count(*) AS points, min(date_time) AS first_point, max(date_time) AS last_point FROM p"
        )
    # Fragments continue the WITH list of their prefix.
    return {name: text.replace(")\n, ", "),\n") for name, text in sql.items()}
