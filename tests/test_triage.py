"""A1-A8, J3 on a small hand-made run."""

import datetime as dt

import pytest

from logloom.operators import triage as T

UTC = dt.timezone.utc


def t(m):
    return dt.datetime(2026, 3, 11, 12, 0, tzinfo=UTC) + dt.timedelta(minutes=m)


@pytest.fixture
def entries(spark):
    rows = [
        ("r1", "driver", "", None, "stderr", "/r1/d", 0, t(0), 20, "INFO start"),
        ("r1", "executor", "0", "app", "stderr", "/r1/e0", 0, t(5), 40, "ERROR java.lang.OutOfMemoryError: heap"),
        ("r1", "executor", "1", "app", "stderr", "/r1/e1", 0, t(3), 40, "ERROR java.lang.OutOfMemoryError: heap"),
        ("r1", "executor", "1", "app", "stderr", "/r1/e1", 1, t(4), 30, "WARN HangingTaskDetector: stuck"),
        ("r1", "driver", "", None, "stderr", "/r1/d", 1, t(9), 40, "ERROR Py4JJavaError: boom"),
        ("r2", "driver", "", None, "stderr", "/r2/d", 0, t(1), 40, "ERROR AnalysisException: no column"),
    ]
    return spark.createDataFrame(rows, "run_key string, source_type string, source_detail string, app_id string, "
                                       "stream string, file_origin string, line_no bigint, timestamp timestamp, "
                                       "level int, line string").withColumn("file_timestamp", __import__(
        "pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("timestamp"))


def test_errors_per_executor(entries):
    assert [(r.source_detail, r.n_errors) for r in T.errors_per_executor(entries).collect()] == [("0", 1), ("1", 1)]


def test_root_causes_and_spread(entries):
    counts = {(r.run_key, r.root_cause): r.n_lines for r in T.root_cause_counts(entries).collect()}
    assert counts == {("r1", "memory"): 2, ("r1", "hanging_tasks"): 1, ("r1", "python_error"): 1,
                      ("r2", "sql_schema"): 1}
    spread = {(r.run_key, r.root_cause): r.spread for r in T.executor_spread(entries).collect()}
    assert spread[("r1", "memory")] == "systemic" and spread[("r1", "hanging_tasks")] == "single"
    assert spread[("r1", "python_error")] == "driver_only"


def test_first_error(entries):
    got = {r.run_key: r.line for r in T.first_error(entries).collect()}
    assert got["r1"] == "ERROR java.lang.OutOfMemoryError: heap" and got["r2"].startswith("ERROR Analysis")


def test_compare_and_actions(spark, entries):
    counts = T.root_cause_counts(entries)
    pairs = spark.createDataFrame([("r2", "r1")], "base_run string, current_run string")
    st = {r.root_cause: r.status for r in T.run_compare(counts, pairs).collect()}
    assert st == {"sql_schema": "gone", "memory": "new", "hanging_tasks": "new", "python_error": "new"}
    acts = {r.root_cause: r.action for r in T.suggested_actions(counts).collect()}
    assert acts["memory"].startswith("Increase executor/driver memory")
    assert acts["python_error"].startswith("Check a specific executor")


def test_timeline(entries):
    r = {x.run_key: x for x in T.error_timeline(entries).collect()}["r1"]
    assert (r.secs_to_first_error, r.run_secs) == (180, 540)
    assert r.first_error == "2026-03-11T12:03:00+00:00"


def test_events_across_blocks(spark):
    """Stack traces stay with their head line whatever block they lie in."""
    from logloom.functions.parse import parse_entries
    from logloom.operators.merge import with_merge_keys
    from logloom.operators.triage import assemble_events, cause_spread

    chain = ["26/03/11 10:00:00 ERROR Job failed: org.apache.spark.SparkException: Job aborted", "\tat a.B.c(B.java:1)",
             "Caused by: java.io.IOException: write failed", "\tat d.E.f(E.java:2)", "  Caused by: java.net.SocketException: reset",
             "\t... 9 more"]
    python = ["26/03/11 10:00:05 ERROR Py4JJavaError: call failed", "Traceback (most recent call last):", '  File "x.py", line 1, in f',
              "ValueError: bad value: 3"]
    files = {
        "a": ["no stamp yet", "nor here", *chain, "26/03/11 10:00:01 INFO fine", *python],
        "b": ["26/03/11 10:00:02 WARN java.lang.OutOfMemoryError: heap", "26/03/11 10:00:03 INFO done"],
        "c": ["never a stamp"] * 5 + ["KeyError: 'k'"],
    }
    rows = [("r", "executor", str(i), "app-1", "stderr", None, f"/r/{f}", n, x)
            for i, (f, lines) in enumerate(files.items()) for n, x in enumerate(lines)]
    lines = spark.createDataFrame(rows, "run_key string, source_type string, source_detail string, app_id string, stream string, "
                                        "file_timestamp timestamp, file_origin string, line_no bigint, line string")
    for block_rows in (1, 2, 3, 1000):
        events = assemble_events(with_merge_keys(parse_entries(lines), block_rows=block_rows))
        got = {(r.file_origin[-1], r.event_line): r for r in events.collect()}
        assert sorted(got, key=str) == [("a", 2), ("a", 8), ("a", 9), ("a", None), ("b", 0), ("b", 1), ("c", None)]
        assert got["a", None].lines == files["a"][:2] and got["a", None]["head"] is None and got["a", None].cause is None
        assert got["a", 2].lines == chain and got["a", 2].n_causes == 2 and got["a", 2].level == 40
        assert (got["a", 2].cause, got["a", 2].cause_class) == ("java.net.SocketException: reset", "java.net.SocketException")
        assert got["a", 9].lines == python and got["a", 9].cause == "ValueError: bad value: 3"
        assert got["b", 0].cause_class == "java.lang.OutOfMemoryError" and got["b", 0].n_lines == 1
        assert got["b", 1].cause is None and got["c", None].lines == files["c"] and got["c", None].cause == "KeyError: 'k'"
        spread = {r.cause_class: (r.n_events, r.n_sources) for r in cause_spread(events).collect()}
        assert spread == {"java.net.SocketException": (1, 1), "ValueError": (1, 1), "java.lang.OutOfMemoryError": (1, 1), "KeyError": (1, 1)}
    bare = assemble_events(with_merge_keys(parse_entries(lines)), with_lines=False)
    assert "lines" not in bare.columns and bare.count() == 7
    assert assemble_events(parse_entries(lines.limit(0))).count() == 0
