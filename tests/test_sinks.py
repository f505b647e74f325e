"""K1-K3: text and JSON-lines output."""

import datetime as dt
import json

import pytest

from logloom.sinks.output import jsonl_line, text_line, write_entries

UTC = dt.timezone.utc
SCHEMA = ("run_key string, source_type string, source_detail string, app_id string, stream string, "
          "file_timestamp timestamp, file_origin string, line_no bigint, timestamp timestamp, level int, line string")


@pytest.fixture
def entries(spark):
    rows = [
        ("r", "executor", "3", "a", "stderr", None, "/r/e3", 0, dt.datetime(2026, 3, 11, 21, 1, 7, 16000, tzinfo=UTC), 30,
         'WARN "quoted" \x1b tab\there'),
        ("r", "driver", "", None, "stacktrace", None, "/r/d", 0, None, None, "at x.y(Z.java:1)"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_text(entries):
    rows = [r.t for r in entries.select(text_line().alias("t")).collect()]
    assert rows[0] == '[exec/3:stderr 2026-03-11T21:01:07] WARN "quoted" \x1b tab\there'
    assert rows[1] == "[driver:stacktrace " + " " * 19 + "] at x.y(Z.java:1)"  # label not truncated


def test_jsonl(entries):
    rows = [r.j for r in entries.select(jsonl_line().alias("j")).collect()]
    a, b = json.loads(rows[0]), json.loads(rows[1])
    assert list(a) == ["source_type", "source_detail", "stream", "timestamp", "level", "file", "line"]
    assert a["timestamp"] == "2026-03-11T21:01:07.016000+00:00" and a["level"] == "WARN"
    assert a["line"] == 'WARN "quoted" \x1b tab\there'
    assert b["timestamp"] is None and b["level"] is None and "timestamp" in b
    assert rows[1].startswith('{"source_type": "driver", "source_detail": "", ')
    # byte-identical to Python's json.dumps (separators and lower-case escapes)
    assert rows[0] == json.dumps(a, ensure_ascii=False) and rows[1] == json.dumps(b, ensure_ascii=False)


def test_jsonl_escapes_keep_literal_backslashes(spark):
    rows = [("r", "driver", "", None, "stderr", None, "/r/d", 0, None, None, "lit \\u001B text \x1f ctl \x0b"),
            ("r", "driver", "", None, "stderr", None, "/r/d", 1, None, None, "\\\x1b odd")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = [r.j for r in df.select(jsonl_line().alias("j")).orderBy("j").collect()]
    for o in out:
        assert o == json.dumps(json.loads(o), ensure_ascii=False)


def test_write_ordered(spark, entries, tmp_path):
    out = str(tmp_path / "o")
    write_entries(entries, out, fmt="jsonl")
    got = [json.loads(x.value) for x in spark.read.text(out).collect()]
    assert [g["source_type"] for g in got] == ["driver", "executor"]  # null-time file sorts first


def test_ordered_part_files_concatenate_in_merge_order(spark, tmp_path):
    import glob

    from logloom.operators.merge import merge_sort_cols, with_merge_keys
    from logloom.sources.adapter import log_entries

    e = log_entries(spark, "/root/testdata/sf0.001")
    out = str(tmp_path / "ordered")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")  # keep the range partitions apart so there are several part files
    try:
        write_entries(e, out, fmt="text")
    finally:
        spark.conf.set(key, old)
    parts = sorted(glob.glob(out + "/part-*"))
    assert len(parts) > 1
    written = [line.rstrip("\n") for p in parts for line in open(p, encoding="utf-8")]
    expected = [r.t for r in with_merge_keys(e).orderBy(*merge_sort_cols()).select(text_line().alias("t")).collect()]
    assert written == expected
