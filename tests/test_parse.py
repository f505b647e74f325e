"""Line functions."""

import datetime as dt

from pyspark.sql import functions as F

from logloom.functions.parse import (iso_timestamp, is_non_blank, level_name, level_numbers, parse_level,
                                     parse_timestamp, source_label, split_lines)

UTC = dt.timezone.utc


def ts_of(spark, lines, text):
    r = lines(text).select(F.unix_micros(parse_timestamp("line")).alias("u")).first()["u"]
    return None if r is None else dt.datetime(1970, 1, 1, tzinfo=UTC) + dt.timedelta(microseconds=r)


def test_short_year_format(spark, lines):
    assert ts_of(spark, lines, "26/03/11 21:01:15 ERROR x") == dt.datetime(2026, 3, 11, 21, 1, 15, tzinfo=UTC)


def test_iso_bracket_offset_ignored(spark, lines):
    got = ts_of(spark, lines, "[2026-03-11T21:01:07.016+0200] [heap] x")
    assert got == dt.datetime(2026, 3, 11, 21, 1, 7, 16000, tzinfo=UTC)


def test_log4j_format(spark, lines):
    assert ts_of(spark, lines, "2026-03-11 21:00:01,234 INFO x") == dt.datetime(2026, 3, 11, 21, 0, 1, 234000,
                                                                              tzinfo=UTC)


def test_no_timestamp(spark, lines):
    assert ts_of(spark, lines, "plain message") is None


def test_pivot_year(spark, lines):
    assert ts_of(spark, lines, "68/01/01 00:00:00").year == 2068
    assert ts_of(spark, lines, "69/01/01 00:00:00").year == 1969
    assert ts_of(spark, lines, "99/12/31 23:59:59").year == 1999


def test_invalid_first_pattern_falls_through(spark, lines):
    # second 60, Feb 30 and hour 24 do not convert; the next pattern is tried
    assert ts_of(spark, lines, "26/03/11 21:01:60 x") is None
    assert ts_of(spark, lines, "26/02/30 10:00:00 x 2026-03-11 21:00:01,234") == dt.datetime(
        2026, 3, 11, 21, 0, 1, 234000, tzinfo=UTC)
    assert ts_of(spark, lines, "26/03/11 24:00:00 x") is None


def test_pattern_priority_not_position(spark, lines):
    got = ts_of(spark, lines, "2026-03-11 21:00:01,234 then 26/03/12 01:02:03")
    assert got == dt.datetime(2026, 3, 12, 1, 2, 3, tzinfo=UTC)


def test_levels(spark, lines):
    rows = lines("26/03/11 ERROR x", "WARN y", "WARNING z", "INFO a", "DEBUG b", "FATAL c", "TRACE d",
                 "error lower", "MY_ERROR x WARNING y", "ÉERROR x", "plain").select(
        parse_level("line").alias("l")).collect()
    assert [r.l for r in rows] == [40, 30, 30, 20, 10, None, None, None, 30, None, None]


def test_level_numbers():
    assert level_numbers("ERROR") == [40]
    assert level_numbers("error, warn") == [30, 40]
    assert level_numbers("WARNING") == [30]
    assert level_numbers("FOO") == []
    assert level_numbers(None) is None
    assert level_numbers("") is None


def test_split_like_splitlines(spark):
    text = "a\x0bb\x85c\r\nd\re f\n\ng"
    df = spark.createDataFrame([(text,)], "t string")
    parts = df.select(split_lines("t").alias("p")).first().p
    assert [p for p in parts if p] == [p for p in text.splitlines() if p]


def test_blank_lines(spark, lines):
    rows = lines("line1", "", "   ", "\t\x1c", "　", "line2").where(is_non_blank("line")).collect()
    assert [r.line for r in rows] == ["line1", "line2"]


def test_label_iso_level_name(spark):
    df = spark.createDataFrame(
        [("driver", "", "stacktrace", dt.datetime(2026, 3, 11, 21, 1, 7, 16000, tzinfo=UTC), 30),
         ("executor", "3", "stderr", dt.datetime(2026, 3, 11, 21, 1, 7, tzinfo=UTC), 10)],
        "source_type string, source_detail string, stream string, ts timestamp, level int")
    rows = df.select(source_label().alias("l"), iso_timestamp("ts").alias("i"), level_name("level").alias("n")).collect()
    assert rows[0].l == "driver:stacktrace" and rows[1].l == "exec/3:stderr"
    assert rows[0].i == "2026-03-11T21:01:07.016000+00:00"
    assert rows[1].i == "2026-03-11T21:01:07+00:00"
    assert [r.n for r in rows] == ["WARN", "DEBUG"]
