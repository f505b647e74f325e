"""Registered queries over log trees written from ``events``, and over lines
derived from ``events`` for the parse and noise rules the plain adapter text
does not reach. Oracles: ``oracle_tree.py``."""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import functions as F

from logloom.functions.parse import iso_timestamp, parse_timestamp
from logloom.operators import filters as flt
from logloom.operators import triage as tri
from logloom.plans.query import query_entries, query_logs, query_logs_report
from logloom.session import ensure_checkpoint_dir
from logloom.sinks.output import write_entries
from logloom.sources import adapter
from logloom.sources.files import discover, normalize_path
from logloom.sources.stats import may_hold, write_file_stats

TAIL_ONE_N = 25
PRUNE_SINCE, PRUNE_GREP = "2024-01-20T12:00:00", "OutOfMemory.*user 1|HangingTask"
SINCE_AGO, SINCE_NOW = "36h", _dt.datetime(2024, 1, 20, 6, 30, tzinfo=_dt.timezone.utc)

# FIXED VALUES: one line for each noise pattern, and lines that are none
NOISE_LINES = [
    '"pool-7 worker" id=9 state=WAITING',
    "  at java.base@21/sun.misc.Loop.spin(Loop.java:5)",
    "  at app//org.acme.Job.main(Job.java:7)",
    "   - locked <0x01ab>",
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
    "chown: invalid group staff",
    "WARNING: Foo is terminally deprecated",
    "WARNING: call of setSecurityManager",
    "WARNING: Please consider reporting this",
    "WARNING: Bar will be removed",
    "job.py:3: SyntaxWarning: invalid escape in a string",
    "Connection to spark from PID 77",
    "Initialized gateway on port 1",
    "Connected to spark.",
]
WHOLE_LINE = "Connected to spark."
PLAIN_LINES = [
    "ERROR MyApp: gave up",
    "Connected to spark. And more",
    "  WARNING: not at the start, terminally deprecated",
    "java.lang.IllegalStateException: no",
]


def _tree(spark, sf_dir):
    return adapter.materialize_log_tree(spark, sf_dir)


def _run():
    return F.regexp_extract("run_key", "[^/]+$", 0).alias("run")


def q_discover_tree(spark, sf_dir):
    """Files of a tree; some roots end in a slash, one is given twice and one
    does not exist."""
    roots = [r if i % 2 else r + "/" for i, r in enumerate(_tree(spark, sf_dir))]
    files = discover(spark, [*roots, roots[0], roots[1] + "-missing"])
    return files.groupBy(_run(), "source_type", "source_detail", "stream").agg(
        F.count("*").alias("n_files"), F.count_if("is_compressed").alias("n_packed"),
        F.min("file_timestamp").cast("string").alias("first_rotation"))


def q_skipped_files(spark, sf_dir):
    _, skipped = query_logs_report(spark, _tree(spark, sf_dir))
    return skipped.select(_run(), "source_type", "source_detail", "stream",
                          F.regexp_extract("path", "[^/]+$", 0).alias("name"))


def q_pruned_tree(spark, sf_dir):
    """A query with since and grep over a tree whose statistics are known: files
    that can't hold a line of it are not opened."""
    roots = _tree(spark, sf_dir)
    stats = write_file_stats(spark, roots, roots[0].rsplit("/", 1)[0] + "-stats")
    out = query_logs(spark, roots, since=PRUNE_SINCE, grep=PRUNE_GREP, stats=stats, ordered=False)
    return out.select(_run(), "source_type", "source_detail", "stream", "line")


def q_file_stats(spark, sf_dir):
    """The statistics themselves; of the bitmap, whether two words may occur."""
    roots = _tree(spark, sf_dir)
    stats = write_file_stats(spark, roots, roots[0].rsplit("/", 1)[0] + "-stats")
    time = lambda c: F.when(F.col(c).isNotNull(), iso_timestamp(F.timestamp_micros(c)))
    return stats.select(
        F.regexp_extract("file_origin", "/(run-[0-9]+/.*)$", 1).alias("file"), "n_lines", time("min_us").alias("first_ts"),
        time("max_us").alias("last_ts"), may_hold(grep="Traceback").alias("may_hold_traceback"),
        may_hold(grep="no such words here").alias("may_hold_others"))


def q_follow_tree(spark, sf_dir):
    """All files of a tree through the streaming follow mode, once."""
    from logloom.streaming.follow import follow_logs, follow_to

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logloom-follow/{uuid.uuid4().hex[:12]}"
    stream = follow_logs(spark, _tree(spark, sf_dir), level="ERROR")
    follow_to(stream, f"{base}/out", f"{base}/state", available_now=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(
        _run(), "source_type", "source_detail", "stream", "line")


def q_follow_growing(spark, sf_dir):
    """Active files that grow and are rotated, followed by a stream that is
    started anew from its checkpoint after every step."""
    from logloom.streaming.follow import follow_logs, follow_to

    base, roots, steps = adapter.growing_tree(spark, sf_dir)
    for step in steps:
        step()
        stream = follow_logs(spark, roots, level="ERROR", growing=True, state=f"{base}-held")
        follow_to(stream, f"{base}-out", f"{base}-state", available_now=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}-out").select(
        _run(), "source_type", "source_detail", "stream", "line")


def q_follow_merged(spark, sf_dir):
    """The merged order of a tree, numbered by the stream."""
    from logloom.streaming.follow import follow_merged, follow_to

    base, roots, steps = adapter.growing_tree(spark, sf_dir)
    steps[-1]()
    stream = follow_merged(spark, roots, idle_seconds=0)
    follow_to(stream, f"{base}-out", f"{base}-state", available_now=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}-out").select(
        _run(), F.col("seq").alias("merge_rank"), "source_type", "source_detail", "stream", "line", "late")


def q_tail_one_stream(spark, sf_dir):
    """Last lines over all runs taken as one stream."""
    out = query_entries(adapter.log_entries(spark, sf_dir), level="ERROR", tail=TAIL_ONE_N, per_run=False, ordered=False)
    return out.select("run_key", "line_no", "line")


def q_write_read_jsonl(spark, sf_dir):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logloom-written/{uuid.uuid4().hex[:12]}"
    write_entries(adapter.log_entries(spark, sf_dir), path, fmt="jsonl", ordered=False)
    return spark.read.text(path).select(F.col("value").alias("json"))


def q_run_timeline(spark, sf_dir):
    """Timelines against the runs' own times, taken from orders."""
    raw = adapter.runs_raw_table(spark, sf_dir)
    runs = raw.select(F.concat(F.lit("run-"), (F.col("run_id") % adapter.N_RUNS).cast("string")).alias("run_key"),
                      "start_time", "end_time")
    return tri.error_timeline(adapter.log_entries(spark, sf_dir), runs)


def q_since_relative(spark, sf_dir):
    return flt.since_filter(adapter.log_entries(spark, sf_dir), SINCE_AGO, SINCE_NOW).select("line_no")


def q_noise_patterns(spark, sf_dir):
    """Rendered lines with a noise line, or one that is none, spliced in front
    (one pattern must be the whole line)."""
    lines = F.array(*map(F.lit, NOISE_LINES + PLAIN_LINES))
    front = F.get(lines, (F.col("line_no") % len(NOISE_LINES + PLAIN_LINES)).cast("int"))
    rows = adapter.log_lines(spark, sf_dir).select(
        F.col("line_no").alias("event_id"), F.when(front == WHOLE_LINE, front).otherwise(F.concat_ws(" ", front, "line")).alias("line"))
    return rows.select("event_id", "line", flt.is_noise("line").alias("noise"))


def fallback_line(event_id, ts):
    """Lines whose first matching stamp does not convert, or needs the pivot,
    with the event's own time in the stamp that counts."""
    n = event_id % 100
    two = F.lpad(n.cast("string"), 2, "0")
    kind = event_id % 4
    return (F.when(kind == 0, F.concat(two, F.date_format(ts, "/MM/dd HH:mm:ss"), F.lit(" INFO a")))
            .when(kind == 1, F.concat(F.lit("24/02/30 05:06:07 ["), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("-0700] "), two))
            .when(kind == 2, F.concat(F.date_format(ts, "yy/MM/dd HH:mm"), F.lit(":60 then "), F.date_format(ts, "yyyy-MM-dd HH:mm:ss,SSS")))
            .otherwise(F.concat(F.lit("[2024-13-01T00:00:00.000+0000] "), F.date_format(ts, "yy/MM/dd"), F.lit(" 24:00:00 "), two)))


def q_timestamp_fallbacks(spark, sf_dir):
    rows = adapter.read_table(spark, sf_dir, "events").select("event_id", fallback_line(F.col("event_id"), F.col("ts")).alias("line"))
    rows = rows.withColumn("ts", parse_timestamp("line"))
    return rows.select("event_id", F.when(F.col("ts").isNotNull(), iso_timestamp("ts")).alias("ts_iso"))


def q_listing_dbfs(spark, sf_dir):
    """Paths with and without a ``dbfs:`` prefix are one path."""
    paths = adapter.listing_table(spark, sf_dir)
    both = paths.unionByName(paths.select(F.concat(F.lit("dbfs:"), F.col("path")).alias("path")))
    return both.select(normalize_path("path").alias("path")).distinct()


TREE_QUERIES = {
    "discover_tree": q_discover_tree,
    "skipped_files": q_skipped_files,
    "pruned_tree": q_pruned_tree,
    "file_stats": q_file_stats,
    "follow_tree": q_follow_tree,
    "follow_growing": q_follow_growing,
    "follow_merged": q_follow_merged,
    "tail_one_stream": q_tail_one_stream,
    "write_read_jsonl": q_write_read_jsonl,
    "run_timeline": q_run_timeline,
    "since_relative": q_since_relative,
    "noise_patterns": q_noise_patterns,
    "timestamp_fallbacks": q_timestamp_fallbacks,
    "listing_dbfs": q_listing_dbfs,
}
