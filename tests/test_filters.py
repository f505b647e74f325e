"""F1-F7, G3, P15."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logloom.operators import filters as flt

UTC = dt.timezone.utc


@pytest.fixture
def entries(spark):
    rows = [
        ("r", "driver", "", "stderr", dt.datetime(2026, 3, 11, 21, 0, tzinfo=UTC), 40, "ERROR a", 0),
        ("r", "executor", "0", "stderr", dt.datetime(2026, 3, 11, 21, 30, tzinfo=UTC), 30, "WARN b", 1),
        ("r", "executor", "3", "stdout", dt.datetime(2026, 3, 11, 21, 59, tzinfo=UTC), 20, "INFO c", 2),
        ("r", "executor", "3", "stderr", None, None, "  at app//x.y(Z.scala:1)", 3),
    ]
    return spark.createDataFrame(rows, "run_key string, source_type string, source_detail string, stream string, "
                                       "timestamp timestamp, level int, line string, line_no bigint")


def ids(df):
    return sorted(r.line_no for r in df.collect())


def test_source(entries):
    assert ids(flt.source_filter(entries, "executor:3")) == [2, 3]
    assert ids(flt.source_filter(entries, "executor")) == [1, 2, 3]
    assert ids(flt.source_filter(entries, "driver")) == [0]
    assert ids(flt.source_filter(entries, "all")) == [0, 1, 2, 3]
    assert ids(flt.source_filter(entries, "executor:3:extra")) == [2, 3]


def test_stream(entries):
    assert ids(flt.stream_filter(entries, "stderr")) == [0, 1, 3]


def test_level(entries):
    assert ids(flt.level_filter(entries, "ERROR")) == [0]
    assert ids(flt.level_filter(entries, "ERROR,WARN")) == [0, 1]
    assert ids(flt.level_filter(entries, "warning")) == [1]
    assert ids(flt.level_filter(entries, "FOO")) == []
    assert ids(flt.level_filter(entries, None)) == [0, 1, 2, 3]


def test_since_inclusive(entries):
    assert ids(flt.since_filter(entries, "2026-03-11T21:30:00")) == [1, 2]


def test_since_forms(spark):
    now = dt.datetime(2026, 3, 11, 12, 0, tzinfo=UTC)
    forms = {"2h": dt.datetime(2026, 3, 11, 10, 0), "30m": dt.datetime(2026, 3, 11, 11, 30),
             "2026-03-11T09:00:00": dt.datetime(2026, 3, 11, 9, 0),
             "2026-03-11T09:00:00+02:00": dt.datetime(2026, 3, 11, 7, 0)}
    row = spark.range(1).select(*[F.unix_micros(flt.since_column(x, now)).alias(x) for x in forms]).first()
    assert row.asDict() == {k: int(v.replace(tzinfo=UTC).timestamp()) * 1_000_000 for k, v in forms.items()}
    with pytest.raises(ValueError):
        flt.since_column("yesterday")


def test_grep(entries):
    assert ids(flt.grep_filter(entries, "^(WARN|INFO)")) == [1, 2]


# one line for each of the 30 patterns
NOISE = [
    '"pool-7 worker" id=9 state=WAITING',
    "  at java.base@21/sun.misc.Loop.spin(Loop.java:5)",
    "\tat app//org.acme.Job.main(Job.java:7)",
    "   - locked <0x01ab>",
    "   - waiting on <0x02cd>",
    "  Locked synchronizers: none",
    "ShuffleBlockFetcherIterator: asked for 8 blocks",
    "Executor: Finished task 4.0",
    "CoarseGrainedExecutorBackend: Got assigned task 12",
    "BlockManager: Removing broadcast 3",
    "BlockManager: Removed broadcast 3",
    "MemoryStore: Block broadcast_3 kept",
    "TorrentBroadcast: Reading broadcast variable 3",
    "TorrentBroadcast: Unpersisting TorrentBroadcast 3",
    "MapOutputTrackerWorker: Doing the fetch again",
    "MapOutputTrackerWorker: Got the output locations of 2",
    "CodeGenerator: Code generated in 3 ms",
    "FilterCompat: Filtering using predicate a > 1",
    "S3AbortableInputStream: Not all bytes were read, 12 left",
    "OpenJDK says warning: flag X is deprecated",
    "SLF4J: two bindings",
    "ANTLR Tool version 9",
    "chown: invalid group 'staff'",
    "WARNING: Foo is terminally deprecated",
    "WARNING: call of setSecurityManager",
    "WARNING: Please consider reporting this",
    "WARNING: Bar will be removed",
    "job.py:3: SyntaxWarning: invalid escape in a string",
    "Connection to spark from PID 77",
    "Initialized gateway on port 1",
    "Connected to spark.",
]
KEEP = [
    "26/03/11 21:01:15 ERROR MyApp: job failed",
    "Traceback (most recent call last):",
    "java.lang.OutOfMemoryError: Java heap space",
    "Connected to spark. Extra",
    "  WARNING: not at start terminally deprecated",
]


def test_focus(spark, lines):
    df = lines(*NOISE, *KEEP)
    kept = [r.line for r in flt.focus_filter(df).collect()]
    assert kept == KEEP


def test_focus_report(spark, lines):
    df = lines(*NOISE, *KEEP).selectExpr("'r' AS run_key", "line")
    r = flt.focus_report(df).first()
    assert (r.removed, r.remaining) == (len(NOISE), len(KEEP))


def test_since_column(spark, entries):
    import datetime as dt

    from pyspark.sql import functions as F

    assert ids(entries.where(F.col("timestamp") >= flt.since_column("2026-03-11T21:30:00"))) == [1, 2]
    # relative: evaluated at query time (the fixture times are far in the past)
    assert ids(entries.where(F.col("timestamp") >= flt.since_column("2h"))) == []
    long_ago = int((dt.datetime.now(tz=dt.timezone.utc) - dt.datetime(2026, 3, 11, tzinfo=dt.timezone.utc)).total_seconds() // 3600) + 1
    assert ids(entries.where(F.col("timestamp") >= flt.since_column(f"{long_ago}h"))) == [0, 1, 2]
