"""End-to-end calls: filter, merge and limit entries the way the command
line of a log viewer does, for any number of runs at once.

Fixed operator order (F7): file filters (source, stream) -> merge keys ->
focus -> level -> since -> grep -> tail -> merged order. File filters sit
below the merge because they remove whole files; line filters sit above it
because merge keys are defined over all lines of a file.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators import filters as flt
from logloom.operators import triage as tri
from logloom.operators.merge import merge_sort_cols, tail as tail_op, with_merge_keys


def query_entries(
    entries: DataFrame,
    source: str = "all",
    stream: str = "all",
    level: str | list[str] | None = None,
    grep: str | None = None,
    since: str | _dt.datetime | None = None,
    tail: int | None = None,
    focus: bool = False,
    ordered: bool = True,
    per_run: bool = True,
    now: _dt.datetime | None = None,
    order_col: str = "line_no",
    block=None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Apply the viewer's options to parsed entries."""
    df = flt.stream_filter(flt.source_filter(entries, source), stream)
    keyed = with_merge_keys(df, order_col=order_col, block=block, num_partitions=num_partitions)
    if focus:
        keyed = flt.focus_filter(keyed)
    keyed = flt.level_filter(keyed, level)
    keyed = flt.since_filter(keyed, since, now)
    keyed = flt.grep_filter(keyed, grep)
    keyed = tail_op(keyed, tail, per_run=per_run, order_col=order_col)
    if ordered:
        keyed = keyed.orderBy(*merge_sort_cols(order_col))
    return keyed


def query_logs(spark, bases, source: str = "all", stream: str = "all", include_log4j: bool = False,
               include_stacktrace: bool = False, strict_corrupt: bool = True, honor_offset: bool = False,
               stats: DataFrame | None = None, **options) -> DataFrame:
    """Read the log trees under ``bases`` and apply the viewer's options.

    Source and stream filters prune files before they are read; a missing
    run directory contributes no rows. With ``stats`` (:mod:`sources.stats`)
    files that can hold no line for ``since`` or ``grep`` are not opened.
    """
    from logloom.sources.scan import scan_logs
    from logloom.sources.stats import left_out

    skip = None if stats is None else left_out(stats, options.get("since"), options.get("grep"), options.get("now"))

    entries = scan_logs(spark, bases, source=source, stream=stream, include_log4j=include_log4j,
                        include_stacktrace=include_stacktrace, strict_corrupt=strict_corrupt,
                        honor_offset=honor_offset, left_out=skip)
    # block = file split is picked up by the merge
    return query_entries(entries, order_col="line_no", **options)


def query_logs_report(spark, bases, include_log4j: bool = False, include_stacktrace: bool = False,
                      strict_corrupt: bool = True, honor_offset: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """(entries, skipped): :func:`query_logs` and the files it had to leave
    out (path, run, source, stream, length), each a DataFrame of its own. The
    files are read once: their lines are written to the checkpoint folder, and
    both come from that table."""
    from logloom.session import write_and_read
    from logloom.sources.files import discover
    from logloom.sources.scan import entries_of, raw_lines, without_rows

    files = discover(spark, bases, include_log4j, include_stacktrace)
    source, stream = options.get("source", "all"), options.get("stream", "all")
    files = flt.stream_filter(flt.source_filter(files, source), stream).select(
        "path", "run_key", "source_type", "source_detail", "stream", "length")
    files = write_and_read(spark, files, "files")  # as listed before the files are read
    lines = write_and_read(spark, raw_lines(spark, bases, source, stream, include_log4j, include_stacktrace, strict_corrupt), "raw-lines")
    entries = query_entries(entries_of(lines, honor_offset), **options)
    return entries, without_rows(files, lines)


def triage(entries: DataFrame, files: DataFrame | None = None, materialize: bool = False) -> dict[str, DataFrame]:
    """The triage workflow as tables: errors by executor and source, root
    causes, first error, spread, timeline and suggested actions.

    Classes are assigned before the focus filter (a shuffle-fetch error is
    noise to the viewer but evidence to triage). With ``materialize`` the
    merge-keyed entries are written once as a parquet table in the
    checkpoint folder and all tables are computed from it (one scan and
    parse instead of one per table).
    """
    if materialize:
        from logloom.session import write_and_read

        keyed = with_merge_keys(entries)
        entries = write_and_read(entries.sparkSession, keyed, "triage-entries")
    counts = tri.root_cause_counts(entries)
    return {
        "errors_per_executor": tri.errors_per_executor(entries),
        "errors_by_source": tri.errors_by_source(entries),
        "root_cause_counts": counts,
        "first_error": tri.first_error(entries),
        "executor_spread": tri.executor_spread(entries, files),
        "error_timeline": tri.error_timeline(entries),
        "suggested_actions": tri.suggested_actions(counts),
    }
