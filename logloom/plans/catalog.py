"""Registered queries: one per operator family, each reading the driver's
tables from ``sf_dir`` (through the adapters) so its work grows with them.

Every function takes ``(spark, sf_dir)`` and returns a DataFrame whose
column names match the oracle SQL of the same name in ``oracle.py``.
Timestamps are returned as ISO strings (P7) so both engines agree on type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.parse import iso_timestamp, is_non_blank, level_name, split_lines
from logloom.operators import filters as flt
from logloom.operators import templates as tpl
from logloom.operators import triage as tri
from logloom.operators.merge import first_stamps, merge_sort_cols, rank_within, with_merge_keys
from logloom.plans.query import query_entries
from logloom.session import write_and_read
from logloom.sinks.output import jsonl_line, text_line
from logloom.sources import adapter

# Query parameters shared with the oracle SQL.
SOURCE = "executor:2"
STREAM = "stdout"
LEVELS = "error, warning"
SINCE = "2024-01-15T12:00:00"
GREP = "OutOfMemory|Py4J"
TAIL_N = 20
TAIL_PER_RUN_N = 15
SKIP_HEAD_N = 100
TAIL_LARGE_N = 1500
TEMPLATE_CHILDREN = 4
COMPARE_PAIRS = [("run-0", "run-1"), ("run-2", "run-3")]
# Block size of the two-level merge used by the registered queries; small
# enough that the sf0.01 files span several blocks.
QUERY_BLOCK_ROWS = 1000


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.log_entries(spark, sf_dir)


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_merge_keys(_entries(spark, sf_dir), block_rows=QUERY_BLOCK_ROWS)


# --------------------------------------------------------------- P1-P4, P7
def q_parse_timestamp(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return e.select("line_no", F.when(F.col("timestamp").isNotNull(), iso_timestamp("timestamp")).alias("ts_iso"))


def q_parse_level(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return e.select("line_no", "level", level_name("level").alias("level_name"))


def q_split_lines(spark, sf_dir):
    docs = adapter.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = docs.select("doc_id", F.posexplode(split_lines("text")).alias("pos", "line"))
    return pieces.where(is_non_blank("line")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


# ------------------------------------------------------------------ F1-F7
def q_source_filter(spark, sf_dir):
    return flt.source_filter(_entries(spark, sf_dir), SOURCE).select("run_key", "line_no", "source_detail")


def q_stream_filter(spark, sf_dir):
    return flt.stream_filter(_entries(spark, sf_dir), STREAM).select("run_key", "line_no", "stream")


def q_level_filter(spark, sf_dir):
    return flt.level_filter(_entries(spark, sf_dir), LEVELS).select("line_no", "level")


def q_since_filter(spark, sf_dir):
    df = flt.since_filter(_entries(spark, sf_dir), SINCE)
    return df.select("line_no", iso_timestamp("timestamp").alias("ts_iso"))


def q_focus_filter(spark, sf_dir):
    return flt.focus_filter(_entries(spark, sf_dir)).select("run_key", "line_no")


def q_focus_report(spark, sf_dir):
    return flt.focus_report(_entries(spark, sf_dir))


def q_grep_filter(spark, sf_dir):
    return flt.grep_filter(_entries(spark, sf_dir), GREP).select("line_no", "line")


# ------------------------------------------------------------- W4/W5, O1-O2
def q_file_first_timestamp(spark, sf_dir):
    return first_stamps(_entries(spark, sf_dir)).select(
        "run_key", "file_origin", iso_timestamp(F.timestamp_micros("first_us")).alias("first_ts"))


def q_merge_order(spark, sf_dir):
    ranked = rank_within(_keyed(spark, sf_dir), ["run_key"], merge_sort_cols()[1:], "merge_rank")
    return ranked.select("run_key", "line_no", "file_origin", iso_timestamp(F.timestamp_micros("merge_ts")).alias("merge_ts"),
                         "merge_rank")


def q_tail(spark, sf_dir):
    out = query_entries(_entries(spark, sf_dir), level="ERROR,WARN", focus=True, tail=TAIL_N, ordered=False,
                        block=F.floor(F.col("line_no") / QUERY_BLOCK_ROWS))
    return out.select("run_key", "line_no", "line")


def q_tail_per_run(spark, sf_dir):
    out = query_entries(_entries(spark, sf_dir), focus=True, tail=TAIL_PER_RUN_N, ordered=False,
                        block=F.floor(F.col("line_no") / QUERY_BLOCK_ROWS))
    return out.select("run_key", "line_no", "line")


def q_skip_head(spark, sf_dir):
    out = query_entries(_entries(spark, sf_dir), level="ERROR", tail=-SKIP_HEAD_N, ordered=False,
                        block=F.floor(F.col("line_no") / QUERY_BLOCK_ROWS))
    return out.select("run_key", "line_no")


def q_tail_large(spark, sf_dir):
    out = query_entries(_entries(spark, sf_dir), level="WARN", tail=TAIL_LARGE_N, ordered=False,
                        block=F.floor(F.col("line_no") / QUERY_BLOCK_ROWS))
    return out.select("run_key", "line_no")


# ------------------------------------------------------------------ K1, K2
def q_format_text(spark, sf_dir):
    return _entries(spark, sf_dir).select("run_key", "line_no", text_line().alias("text"))


def q_format_jsonl(spark, sf_dir):
    return _entries(spark, sf_dir).select("run_key", "line_no", jsonl_line().alias("json"))


# ------------------------------------------------------------------ A1-A8
def q_errors_per_executor(spark, sf_dir):
    return tri.errors_per_executor(_entries(spark, sf_dir))


def q_errors_by_source(spark, sf_dir):
    return tri.errors_by_source(_entries(spark, sf_dir))


def q_root_cause_counts(spark, sf_dir):
    return tri.root_cause_counts(_entries(spark, sf_dir))


def q_first_error(spark, sf_dir):
    return tri.first_error(_keyed(spark, sf_dir))


def _events(spark, sf_dir):
    """Events of the log lines, whose stack frames here are links of a chain,
    ends of a traceback, or frames."""
    e, n = _entries(spark, sf_dir), F.col("line_no").cast("string")
    link = F.when(F.col("line_no") % 7 < 3, F.concat(F.lit("Caused by: org.acme.Fault"), (F.col("line_no") % 7).cast("string"),
                                                     F.lit("Exception: event "), n))
    link = link.when(F.col("line_no") % 7 == 3, F.concat(F.lit("acme.RangeError: event "), n)).otherwise(F.lit(adapter.STACK_LINE))
    e = e.withColumn("line", F.when(F.col("line") == adapter.STACK_LINE, link).otherwise(F.col("line")))
    return tri.assemble_events(with_merge_keys(e, block_rows=QUERY_BLOCK_ROWS))


def q_events(spark, sf_dir):
    return _events(spark, sf_dir).select(
        "run_key", "file_origin", "event_line", "level", "head", "n_lines", "n_causes", "cause", "cause_class",
        F.array_join("lines", "\n").alias("text"))


def q_cause_spread(spark, sf_dir):
    out = tri.cause_spread(_events(spark, sf_dir))
    return out.withColumn("first_seen", iso_timestamp(F.timestamp_micros("first_us"))).drop("first_us")


def _template_counts(spark, sf_dir):
    """Templates of all lines; users have names here, so that not only masked
    shapes vary."""
    e = _entries(spark, sf_dir)
    e = e.withColumn("line", F.regexp_replace("line", "user ([0-9]+)$", "user u$1"))
    found = write_and_read(spark, tpl.mine_templates(e, children=TEMPLATE_CHILDREN), "templates")
    return tpl.template_counts(e, found), tri.executor_counts(tri.files_of(e))


def q_template_spread(spark, sf_dir):
    counts, executors = _template_counts(spark, sf_dir)
    return tpl.template_spread(counts, executors)


def q_template_compare(spark, sf_dir):
    pairs = spark.createDataFrame(COMPARE_PAIRS, "base_run string, current_run string")
    return tpl.template_compare(_template_counts(spark, sf_dir)[0], pairs)


def q_executor_spread(spark, sf_dir):
    return tri.executor_spread(_entries(spark, sf_dir))


def q_run_compare(spark, sf_dir):
    pairs = spark.createDataFrame(COMPARE_PAIRS, "base_run string, current_run string")
    return tri.run_compare(tri.root_cause_counts(_entries(spark, sf_dir)), pairs)


def q_error_timeline(spark, sf_dir):
    return tri.error_timeline(_entries(spark, sf_dir))


def q_suggested_actions(spark, sf_dir):
    return tri.suggested_actions(tri.root_cause_counts(_entries(spark, sf_dir))).select(
        "run_key", "root_cause", "n_lines", "action"
    )


# ------------------------------------------------- S11-S13, P1, P5, U1 on files
def _tree(spark, sf_dir):
    return adapter.materialize_log_tree(spark, sf_dir)


def q_scan_tree(spark, sf_dir):
    """Scan a real log tree written from events: every line back with its
    file attributes, timestamp and level."""
    from logloom.sources.scan import scan_logs

    e = scan_logs(spark, _tree(spark, sf_dir))
    return e.select(F.regexp_extract("run_key", "[^/]+$", 0).alias("run"), "source_type", "source_detail", "stream",
                    "line", "level", F.when(F.col("timestamp").isNotNull(), iso_timestamp("timestamp")).alias("ts_iso"))


def q_query_logs_tree(spark, sf_dir):
    """The whole viewer pipeline over the files: scan, merge, focus,
    ERROR/WARN, last lines per run."""
    from logloom.plans.query import query_logs

    out = query_logs(spark, _tree(spark, sf_dir), level="ERROR,WARN", focus=True, tail=TAIL_N, ordered=False)
    return out.select(F.regexp_extract("run_key", "[^/]+$", 0).alias("run"), "source_type", "source_detail",
                      "stream", "line")


# ------------------------------------------------------------ flagship
def q_flagship(spark, sf_dir):
    """parse -> focus -> ERROR,WARN -> merge order -> last 50 per run, ranked."""
    out = query_entries(_entries(spark, sf_dir), focus=True, level="ERROR,WARN", tail=50, ordered=False,
                        block=F.floor(F.col("line_no") / QUERY_BLOCK_ROWS))
    # the tail left 50 rows of a run at most
    ranked = out.withColumn("merge_rank", F.row_number().over(Window.partitionBy("run_key").orderBy(*merge_sort_cols()[1:])))
    return ranked.select("run_key", F.col("merge_rank").cast("bigint").alias("merge_rank"), "line_no", text_line().alias("text"))


LOG_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parse_timestamp": q_parse_timestamp,
    "parse_level": q_parse_level,
    "split_lines": q_split_lines,
    "source_filter": q_source_filter,
    "stream_filter": q_stream_filter,
    "level_filter": q_level_filter,
    "since_filter": q_since_filter,
    "focus_filter": q_focus_filter,
    "focus_report": q_focus_report,
    "grep_filter": q_grep_filter,
    "file_first_timestamp": q_file_first_timestamp,
    "merge_order": q_merge_order,
    "tail": q_tail,
    "tail_per_run": q_tail_per_run,
    "skip_head": q_skip_head,
    "tail_large": q_tail_large,
    "format_text": q_format_text,
    "format_jsonl": q_format_jsonl,
    "errors_per_executor": q_errors_per_executor,
    "errors_by_source": q_errors_by_source,
    "root_cause_counts": q_root_cause_counts,
    "first_error": q_first_error,
    "events": q_events,
    "cause_spread": q_cause_spread,
    "template_spread": q_template_spread,
    "template_compare": q_template_compare,
    "executor_spread": q_executor_spread,
    "run_compare": q_run_compare,
    "error_timeline": q_error_timeline,
    "suggested_actions": q_suggested_actions,
    "flagship": q_flagship,
    "scan_tree": q_scan_tree,
    "query_logs_tree": q_query_logs_tree,
}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from logloom.plans.catalog_runs import RUN_QUERIES
    from logloom.plans.catalog_tree import TREE_QUERIES

    return {**LOG_QUERIES, **RUN_QUERIES, **TREE_QUERIES}
