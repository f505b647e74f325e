"""Follow the logs of running jobs (T1) with Structured Streaming.

Two sources: Spark's file source picks up each new file under the run roots
once, whole (for trees that only get rotated files); with ``growing`` the lines
appended to active files arrive too, each once however files are rotated (see
:mod:`growing`). Per-line work is the same stateless parse and filter chain as the
batch path; :mod:`merged` puts the lines of a run into merged order.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.parse import is_non_blank, parse_entries, split_lines
from logloom.operators import filters as flt
from logloom.sources.files import normalize_path
from logloom.sources.scan import select_files
from logloom.streaming.growing import GrowingFiles


def _glob(roots: list[str]) -> str:
    """One Hadoop glob for the log files of all roots: the roots' common
    directory, then a brace alternation of the per-root patterns."""
    parts = [r.rstrip("/").split("/") for r in roots]
    common = []
    for level in zip(*parts):
        if len(set(level)) != 1:
            break
        common.append(level[0])
    if len(common) == min(len(p) for p in parts):  # one root is an ancestor of another (or a single root)
        common = common[:-1]
    out = []
    for p in parts:
        rel = "/".join(p[len(common):])
        out += [f"{rel}/driver/*", f"{rel}/executor/*/*/*"]
    return "/".join(common) + "/{" + ",".join(out) + "}"


def follow_logs(spark: SparkSession, roots: str | list[str], source: str = "all", stream: str = "all",
                level: str | list[str] | None = None, grep: str | None = None, focus: bool = False,
                since: str | None = None,
                include_log4j: bool = False, include_stacktrace: bool = False,
                max_files_per_trigger: int | None = None, growing: bool = False,
                state: str | None = None) -> DataFrame:
    """Streaming DataFrame of parsed, filtered lines of new log files.

    Files are read line by line, so a plain file of any size is followed. A
    damaged gzip file gives the lines before the damage; none with ``growing``,
    which also adds ``line_no``, the place (byte, part) of a line in its file.
    ``state`` is a folder of the growing source's own, kept over restarts.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    entries = follow_growing(spark, roots, source, stream, include_log4j, include_stacktrace, state) if growing else _new_files(
        spark, roots, source, stream, include_log4j, include_stacktrace, max_files_per_trigger)
    if focus:
        entries = flt.focus_filter(entries)
    entries = flt.level_filter(entries, level)
    if since is not None:  # relative values are re-evaluated in every micro-batch
        entries = entries.where(F.col("timestamp") >= flt.since_column(since))
    return flt.grep_filter(entries, grep)


def follow_growing(spark: SparkSession, roots: list[str], source: str = "all", stream: str = "all",
                   include_log4j: bool = False, include_stacktrace: bool = False,
                   state: str | None = None, range_bytes: int | None = None) -> DataFrame:
    """Parsed lines of all selected files as they grow, unfiltered. ``fresh``
    is true where no byte of the file was read before the batch."""
    spark.dataSource.register(GrowingFiles)
    reader = spark.readStream.format("logloom_growing").option("roots", json.dumps(roots))
    if range_bytes:
        reader = reader.option("rangeBytes", str(range_bytes))
    if state:
        reader = reader.option("state", state)
    files = select_files(reader.load(), roots, source, stream, include_log4j, include_stacktrace)
    files = files.withColumn("file_origin", normalize_path("_uri", encoded=True)).drop("_uri")
    keep = [c for c in files.columns if c not in ("value", "at")]
    lines = files.select(*keep, "at", F.posexplode(split_lines("value")).alias("part", "line"))
    lines = lines.select(*keep, F.struct("at", F.col("part").cast("long").alias("row")).alias("line_no"), "line")
    return parse_entries(lines.where(is_non_blank("line")))


def follow_merged(spark: SparkSession, roots: str | list[str], source: str = "all", stream: str = "all",
                  level: str | list[str] | None = None, grep: str | None = None, focus: bool = False,
                  include_log4j: bool = False, include_stacktrace: bool = False, delay: str = "10 minutes",
                  idle_seconds: float = 600, state: str | None = None) -> DataFrame:
    """Follow growing files with the lines of each run in merged order, numbered
    by ``seq`` before the filters (see :mod:`merged`)."""
    from logloom.streaming.merged import merged_stream

    roots = [roots] if isinstance(roots, str) else list(roots)
    entries = follow_growing(spark, roots, source, stream, include_log4j, include_stacktrace, state)
    entries = merged_stream(entries, delay, idle_seconds)
    if focus:
        entries = flt.focus_filter(entries)
    return flt.grep_filter(flt.level_filter(entries, level), grep)


def _new_files(spark, roots, source, stream, include_log4j, include_stacktrace, max_files_per_trigger) -> DataFrame:
    reader = (spark.readStream.format("text").option("ignoreCorruptFiles", "true")
              .option("ignoreMissingFiles", "true"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    raw = reader.load(_glob(roots)).select(
        F.make_valid_utf8("value").alias("value"),
        F.col("_metadata.file_path").alias("_uri"),
    )
    files = select_files(raw, roots, source, stream, include_log4j, include_stacktrace)
    files = files.withColumn("file_origin", normalize_path("_uri", encoded=True)).drop("_uri")
    keep = [c for c in files.columns if c != "value"]
    lines = files.select(*keep, F.explode(split_lines("value", full=False)).alias("line"))
    return parse_entries(lines.where(is_non_blank("line")))


def follow_to(df: DataFrame, path: str, checkpoint: str, available_now: bool = False,
              processing_time: str = "30 seconds"):
    """Start an append-only parquet sink with a checkpoint (restartable)."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.outputMode("append").start()
