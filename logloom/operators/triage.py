"""Triage aggregates over entries.

All of them are grouped aggregates with map-side partial aggregation, so a
hot run or a hot class never gathers its rows in one task; the only joins
are to tables with one row per (run, class) or to fixed lookup tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import rules
from logloom.functions.parse import iso_timestamp, level_name
from logloom.operators.merge import file_sort_key, with_merge_keys

ERROR = 40
WARN = 30


def _errors(df: DataFrame, levels=(ERROR,)) -> DataFrame:
    return df.where(F.col("level").isin(list(levels)))


# ----------------------------------------------------------------------- A1
def errors_per_executor(entries: DataFrame) -> DataFrame:
    """Error lines per executor of each run, most first."""
    return (
        _errors(entries)
        .where(F.col("source_type") == "executor")
        .groupBy("run_key", "source_detail")
        .agg(F.count(F.lit(1)).alias("n_errors"))
        .orderBy("run_key", F.col("n_errors").desc(), "source_detail")
    )


# ----------------------------------------------------------------------- A2
def errors_by_source(entries: DataFrame, levels=(ERROR, WARN)) -> DataFrame:
    """Error and warning lines per source (driver, each executor) and level."""
    return (
        _errors(entries, levels)
        .groupBy("run_key", "source_type", "source_detail", "level")
        .agg(F.count(F.lit(1)).alias("n_lines"))
        .withColumn("level_name", level_name("level"))
    )


# ----------------------------------------------------------------------- A3
def root_causes(line: Column | str = "line") -> Column:
    """Array of root-cause classes whose pattern occurs in the line
    (a line can carry several), in rule priority order."""
    col = F.col(line) if isinstance(line, str) else line
    return F.array_compact(F.array(*[F.when(col.rlike(p), F.lit(c)) for _, c, p in rules.ROOT_CAUSE_RULES]))


def classify(entries: DataFrame, levels=(ERROR, WARN)) -> DataFrame:
    """One row per (line, class) for error/warning lines that match a rule."""
    return _errors(entries, levels).withColumn("root_cause", F.explode(root_causes("line")))


def root_cause_counts(entries: DataFrame, levels=(ERROR, WARN)) -> DataFrame:
    src = F.concat(F.col("source_type"), F.lit(":"), F.col("source_detail"))
    return (
        classify(entries, levels)
        .groupBy("run_key", "root_cause")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct(src).alias("n_sources"))
    )


# ----------------------------------------------------------------------- A4
FIRST_ERROR_FIELDS = ["timestamp", "source_type", "source_detail", "stream", "line", "file_origin", "line_no"]


def first_error(entries: DataFrame, order_col: str = "line_no") -> DataFrame:
    """Earliest error of each run in merged order (likely root cause)."""
    keyed = entries if "merge_ts" in entries.columns else with_merge_keys(entries, order_col=order_col)
    order = F.struct(F.col("merge_ts").alias("m"), file_sort_key().alias("f"), F.col(order_col).alias("l"))
    picked = (
        _errors(keyed)
        .groupBy("run_key")
        .agg(F.min_by(F.struct(*FIRST_ERROR_FIELDS), order).alias("e"), F.count(F.lit(1)).alias("n_errors"))
    )
    return picked.select(
        "run_key",
        F.when(F.col("e.timestamp").isNotNull(), iso_timestamp("e.timestamp")).alias("first_error_time"),
        *[F.col(f"e.{c}").alias(c) for c in FIRST_ERROR_FIELDS[1:]],
        "n_errors",
    )


# ------------------------------------------------- A4: events and their causes
def cause_of(line: str = "line"):
    """What a line says is wrong: the text behind ``Caused by:``, a line that is
    an exception and its message (as tracebacks end), null for other lines."""
    text = F.col(line)
    caused = F.regexp_extract(text, rules.CAUSED_BY, 1)
    raised = F.regexp_extract(text, rules.RAISED, 1)
    return F.when(caused != "", caused).when(raised != "", raised)


def assemble_events(entries: DataFrame, order_col: str = "line_no", with_lines: bool = True) -> DataFrame:
    """One row per event: a line with a timestamp and the lines without one that
    follow it in its file (stack trace, traceback), whatever blocks they lie in;
    what precedes a file's first timestamp is an event without head.

    ``cause`` is the innermost one: the last link of the ``Caused by`` chain, or
    the last exception line, else the exception named in the head line;
    ``cause_class`` its exception class. ``lines`` are all lines in order (an
    event then has to fit into a row; without them all columns are aggregated
    before the shuffle)."""
    keyed = entries if "event_line" in entries.columns else with_merge_keys(entries, order_col=order_col)
    head = F.col("timestamp").isNotNull()
    rows = keyed.select(
        "run_key", "file_origin", "source_type", "source_detail", "stream", "event_line", "merge_ts", "timestamp", "level", "line",
        F.col(order_col).alias("_at"), F.when(~head, cause_of()).alias("_cause"), head.alias("_is_head"))
    linked = F.col("_cause").isNotNull()
    found = [
        F.min("merge_ts").alias("merge_ts"), F.max("timestamp").alias("timestamp"), F.max(F.when(F.col("_is_head"), F.col("level"))).alias("level"),
        F.max(F.when(F.col("_is_head"), F.col("line"))).alias("head"), F.count("*").alias("n_lines"), F.count_if(linked).alias("n_causes"),
        F.max_by("_cause", F.when(linked, F.col("_at"))).alias("_cause")]
    if with_lines:
        found.append(F.transform(F.sort_array(F.collect_list(F.struct("_at", "line"))), lambda x: x["line"]).alias("lines"))
    out = rows.groupBy("run_key", "file_origin", "source_type", "source_detail", "stream", "event_line").agg(*found)
    named = F.regexp_extract(F.coalesce("head", F.lit("")), rules.NAMED_EXCEPTION, 0)
    out = out.withColumn("cause", F.coalesce("_cause", F.when(named != "", named))).drop("_cause")
    return out.withColumn("cause_class", F.when(F.col("cause").isNotNull(), F.regexp_extract("cause", r"^[^:\s]+", 0)))


def cause_spread(events: DataFrame) -> DataFrame:
    """Per run and innermost cause class: events, sources with it, and when it
    was first seen (merged order)."""
    src = F.concat_ws(":", "source_type", "source_detail")
    return events.where(F.col("cause_class").isNotNull()).groupBy("run_key", "cause_class").agg(
        F.count("*").alias("n_events"), F.countDistinct(src).alias("n_sources"), F.min("merge_ts").alias("first_us"))


# ------------------------------------------------------------------- G1 (entries)
def files_of(entries: DataFrame) -> DataFrame:
    """Distinct files seen in entries (one row per file)."""
    return entries.groupBy("run_key", "file_origin", "source_type", "source_detail", "app_id", "stream").agg(
        F.count(F.lit(1)).alias("n_lines")
    )


def executor_counts(files: DataFrame) -> DataFrame:
    """Executor sources per run: (app, executor dir) pairs with a file."""
    ex = F.when(F.col("source_type") == "executor", F.concat_ws("/", F.col("app_id"), F.col("source_detail")))
    return files.groupBy("run_key").agg(F.countDistinct(ex).cast("int").alias("executor_count"))


# ----------------------------------------------------------------------- A5
def executor_spread(entries: DataFrame, files: DataFrame | None = None, levels=(ERROR, WARN)) -> DataFrame:
    """How many executors show each class: all (systemic), one, or some."""
    files = files if files is not None else files_of(entries)
    ex = F.when(F.col("source_type") == "executor", F.concat_ws("/", F.col("app_id"), F.col("source_detail")))
    per_class = (
        classify(entries, levels)
        .groupBy("run_key", "root_cause")
        .agg(F.countDistinct(ex).cast("int").alias("n_executors"), F.count(F.lit(1)).alias("n_lines"))
    )
    n, tot = F.col("n_executors"), F.col("executor_count")
    spread = (
        F.when(n == 0, F.lit("driver_only"))
        .when(n == tot, F.lit("systemic"))
        .when(n == 1, F.lit("single"))
        .otherwise(F.lit("partial"))
    )
    return per_class.join(executor_counts(files), "run_key", "left").withColumn("spread", spread)


# ------------------------------------------------------------------- A6 / J3
def run_compare(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Error classes of two runs side by side: new, gone or common.

    ``counts``: (run_key, root_cause, n_lines); ``pairs``: (base_run,
    current_run). Full outer join on (pair, class).
    """
    c = counts.select("run_key", "root_cause", "n_lines")
    base = pairs.join(c.withColumnRenamed("run_key", "base_run"), "base_run").withColumnRenamed("n_lines", "n_base")
    cur = pairs.join(c.withColumnRenamed("run_key", "current_run"), "current_run").withColumnRenamed(
        "n_lines", "n_current"
    )
    both = base.join(cur, ["base_run", "current_run", "root_cause"], "full_outer")
    status = (
        F.when(F.col("n_base").isNull(), F.lit("new"))
        .when(F.col("n_current").isNull(), F.lit("gone"))
        .otherwise(F.lit("common"))
    )
    return both.withColumn("status", status)


# ----------------------------------------------------------------------- A7
def error_timeline(entries: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """First/last error, the run's start and end, and the spans between them.

    With ``runs`` (run_key, start_time, end_time in epoch milliseconds, as a
    resolved run has them) start and end are the run's own; a run without
    them there, or without ``runs``, falls back to its first and last line."""
    ts = F.col("timestamp")
    is_err = F.col("level") == ERROR
    agg = entries.groupBy("run_key").agg(
        F.min(ts).alias("_start"),
        F.max(ts).alias("_end"),
        F.min(F.when(is_err, ts)).alias("_first"),
        F.max(F.when(is_err, ts)).alias("_last"),
    )
    if runs is not None:
        own = runs.groupBy("run_key").agg(F.min("start_time").alias("_s"), F.max("end_time").alias("_e"))
        agg = agg.join(own, "run_key", "left").withColumns({
            "_start": F.coalesce(F.timestamp_millis("_s"), "_start"), "_end": F.coalesce(F.timestamp_millis("_e"), "_end")})

    def secs(a: str, b: str) -> Column:
        return F.expr(f"(unix_micros({a}) - unix_micros({b})) div 1000000")

    return agg.select(
        "run_key",
        iso_timestamp("_start").alias("run_start"),
        iso_timestamp("_end").alias("run_end"),
        iso_timestamp("_first").alias("first_error"),
        iso_timestamp("_last").alias("last_error"),
        secs("_first", "_start").alias("secs_to_first_error"),
        secs("_end", "_start").alias("run_secs"),
    )


# ----------------------------------------------------------------------- A8
def actions_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules.SUGGESTED_ACTIONS, "root_cause string, action string")


def suggested_actions(counts: DataFrame) -> DataFrame:
    """Action text per (run, class); the lookup has six fixed rows, so it
    is broadcast."""
    acts = F.broadcast(actions_table(counts.sparkSession))
    return counts.join(acts, "root_cause", "left").withColumn(
        "action", F.coalesce(F.col("action"), F.lit(rules.UNCLEAR_ACTION))
    )
