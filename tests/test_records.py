"""CSV files with line breaks in quoted texts: parallel blocks give the rows of one task."""

import csv
import gzip
import io
import random

import pytest

from observations import DEFECT_ROWS
from tidewatch import schema as S
from tidewatch.sources import readers


def text_of(rows, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(S.REQUIRED_COLUMNS)
    writer.writerows(rows)
    return out.getvalue()


def with_texts(texts):
    return [(*DEFECT_ROWS[i % 9][:6], text, DEFECT_ROWS[i % 9][7], float(i)) for i, text in enumerate(texts)]


def read(spark, path, parallel, block=None):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        if block:
            spark.conf.set(key, block)
        raw = readers.read_raw_csv(spark, str(path), parallel=parallel)
        rows = raw.orderBy(S.ROW_ORD).collect()
        places = raw.select(f"{S.ROW_ORD}.*").distinct().count()
    finally:
        spark.conf.set(key, before)
    assert places == len(rows)
    return [tuple(r)[:-1] for r in rows], len({r[S.ROW_ORD]["block"] for r in rows})


AWKWARD = ["plain", 'say "so", then', "two\nlines", '"\n"', "\n\n", '""', 'a\n"b"\n\nc', ",\n,", "", "é\n日", " x ", '"', "\n", "end"]


@pytest.mark.parametrize("shift", range(0, 64, 13))
def test_every_place_meets_a_border(spark, tmp_path, shift):
    """One row is widened step by step, so that borders fall on all parts of the others."""
    path = tmp_path / "f.csv"
    path.write_text(text_of(with_texts(["p" * shift, *AWKWARD])), newline="")
    whole, one = read(spark, path, parallel=False)
    found, blocks = read(spark, path, parallel=True, block=61)
    assert found == whole and len(whole) == len(AWKWARD) + 1
    assert one == 1 and blocks > 5


@pytest.mark.parametrize("seed", range(2))
def test_random_texts(spark, tmp_path, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice('ab"\n, ') for _ in range(rng.randrange(30))) for _ in range(60)]
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text(text_of(with_texts(texts)), newline="")
        rng.shuffle(texts)
    whole, _ = read(spark, tmp_path, parallel=False)
    assert read(spark, tmp_path, parallel=True, block=rng.randrange(150, 400))[0] == whole


def test_a_record_over_many_blocks(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text(text_of(with_texts(["before", "line\n" * 300, "after\nit"])), newline="")
    assert read(spark, path, parallel=True, block=100)[0] == read(spark, path, parallel=False)[0]


def test_windows_line_ends_and_gzip(spark, tmp_path):
    path = tmp_path / "f.csv.gz"
    path.write_bytes(gzip.compress(text_of(with_texts(["two\nlines", "x"]), "\r\n").encode()))
    rows, _ = read(spark, path, parallel=True)
    assert [r[6] for r in rows] == ["two\nlines", "x"] and [r[8] for r in rows] == ["0.0", "1.0"]


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text(text_of(with_texts(["two\nlines"] * 400)), newline="")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, 4096)
    try:
        assert readers.read_raw_csv(spark, str(path)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set(key, before)


def test_irregular_quotes_are_refused_and_one_task_reads_them(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text(text_of(with_texts(["x"])) + 'None,281.4,0.0,0.0,62,Rain,5" deep 6" wide,2021-11-11 18:00:00,1.0\n')
    with pytest.raises(Exception, match="parallel=False"):
        readers.read_raw_csv(spark, str(path)).collect()
    assert read(spark, path, parallel=False)[0][1][6] == '5" deep 6" wide'


def test_header_alone(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text(text_of([]))
    assert read(spark, path, parallel=True)[0] == []
