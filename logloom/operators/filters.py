"""Row filters over entries or files (F1-F7) and the focus report.

Source and stream filters act on whole files, so they are safe below the
merge and can prune files before any byte is read. Level, since, focus
and grep act on lines: apply them after merge keys are defined.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import rules
from logloom.functions.parse import level_numbers


def _line(c: Column | str = "line") -> Column:
    return F.col(c) if isinstance(c, str) else c


# ----------------------------------------------------------------------- F1
def source_predicate(source: str = "all") -> Column:
    """``all`` / ``driver`` / ``executor`` / ``executor:N`` (N compared as text)."""
    if source == "all":
        return F.lit(True)
    if source.startswith("executor:"):
        detail = source.split(":")[1]
        return (F.col("source_type") == "executor") & (F.col("source_detail") == detail)
    return F.col("source_type") == source


def source_filter(df: DataFrame, source: str = "all") -> DataFrame:
    return df if source == "all" else df.where(source_predicate(source))


# ----------------------------------------------------------------------- F2
def stream_filter(df: DataFrame, stream: str = "all") -> DataFrame:
    return df if stream == "all" else df.where(F.col("stream") == stream)


# ----------------------------------------------------------------------- F3
def level_filter(df: DataFrame, levels: str | list[str] | None) -> DataFrame:
    """Keep lines whose level is one of ``levels``; unknown names are
    ignored, and if none is known no line passes. Null levels never pass."""
    nums = level_numbers(levels)
    if nums is None:
        return df
    if not nums:
        return df.where(F.lit(False))
    return df.where(F.col("level").isin(nums))


# ---------------------------------------------------------------------- P15
# unit of a relative ``since`` -> seconds
SINCE_UNITS = {"h": 3600, "m": 60}


def since_column(since: str | _dt.datetime, now: _dt.datetime | None = None) -> Column:
    """``since`` as a timestamp column. ``2h`` / ``30m`` count back from
    ``now``, by default the query's own ``current_timestamp()`` (in a stream:
    each micro-batch's). Anything else is an ISO date-time or a datetime; one
    without an offset is UTC."""
    if isinstance(since, str):
        count, unit = since[:-1], since[-1:]
        if unit in SINCE_UNITS and count.isascii() and count.isdigit():
            base = F.current_timestamp() if now is None else F.lit(now)
            return F.timestamp_micros(F.unix_micros(base) - F.lit(int(count) * SINCE_UNITS[unit] * 1_000_000))
        since = _dt.datetime.fromisoformat(since)
    return F.lit(since if since.tzinfo else since.replace(tzinfo=_dt.timezone.utc))


# ----------------------------------------------------------------------- F4
def since_filter(df: DataFrame, since: str | _dt.datetime | None, now: _dt.datetime | None = None) -> DataFrame:
    """Lines with their own timestamp at or after ``since``."""
    # a null timestamp compares to null and is dropped
    return df if since is None else df.where(F.col("timestamp") >= since_column(since, now))


# ----------------------------------------------------------------------- F5
def _noise_regex() -> str:
    parts = rules.THREAD_DUMP_PATTERNS + rules.JVM_STARTUP_PATTERNS + rules.PYSPARK_GATEWAY_PATTERNS
    return "(?U)" + "|".join(f"(?:{p})" for p in parts)


NOISE_REGEX = _noise_regex()


def is_noise(line: Column | str = "line") -> Column:
    """True for platform noise: one regex for the pattern families, plain
    substring tests (no regex) for the Spark-internal messages."""
    col = _line(line)
    hit = col.rlike(NOISE_REGEX)
    for s in rules.SPARK_NOISE_SUBSTRINGS:
        hit = hit | col.contains(s)
    return hit


def focus_filter(df: DataFrame, line: str = "line") -> DataFrame:
    return df.where(~is_noise(line))


# ----------------------------------------------------------------------- G3
def focus_report(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Removed and remaining line counts of the focus filter, per run."""
    by = ["run_key"] if by is None else by
    agg = df.groupBy(*by).agg(F.count_if(is_noise()).alias("removed"), F.count(F.lit(1)).alias("_n"))
    return agg.withColumn("remaining", F.col("_n") - F.col("removed")).drop("_n")


# ----------------------------------------------------------------------- F6
def grep_filter(df: DataFrame, pattern: str | None, line: str = "line") -> DataFrame:
    """Lines matching a regular expression (Java dialect)."""
    return df if not pattern else df.where(_line(line).rlike(pattern))
