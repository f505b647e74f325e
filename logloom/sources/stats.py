"""Statistics of log files (F4, F6): which files can't hold what a query asks for.

A table with a row per file: its size when it was read, its lines, its least and
greatest timestamp, and a bitmap of the hashes of all three consecutive
characters in it. A query with ``since`` or ``grep`` leaves a file out before it is
opened if no line of it can pass: the file's greatest timestamp is too early, or
no alternative of the pattern has all its character triples in the bitmap.
Results are those of the query without the table.

A file whose size has changed since, and one the table does not know, is read.
Patterns are used as far as they are text, alternatives (``a|b``) and ``.*``; of
any other one nothing is concluded. What the driver holds is the names of the
files left out.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.filters import since_column

SLOTS = 32768  # bits of Spark's bitmaps
_LITERAL = re.compile(r"[A-Za-z0-9_ :/,;=<>@%&~\"'#!-]*")


def _slot(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(SLOTS))


def file_stats(entries: DataFrame) -> DataFrame:
    """(file_origin, file_size, n_lines, min_us, max_us, triples) of scanned
    entries (:func:`scan.scan_logs` with the same options as the queries).
    Bits are collected per file before the shuffle."""
    us = F.unix_micros("timestamp")
    times = entries.groupBy("file_origin", "file_size").agg(
        F.count("*").alias("n_lines"), F.min(us).alias("min_us"), F.max(us).alias("max_us"))
    places = F.when(F.length("line") >= 3, F.sequence(F.lit(1), F.length("line") - 2)).otherwise(F.array().cast("array<int>"))
    slots = F.array_distinct(F.transform(places, lambda i: _slot(F.substring(F.col("line"), i, F.lit(3)))))
    bits = entries.select("file_origin", "file_size", F.explode(slots).alias("slot")).groupBy("file_origin", "file_size").agg(
        F.bitmap_construct_agg("slot").alias("triples"))
    return times.join(bits, ["file_origin", "file_size"], "left")


def required_texts(pattern: str) -> list[list[str]] | None:
    """For each alternative of a pattern, texts a matching line must hold; None
    if the pattern is more than text, ``|`` and ``.*``."""
    found = [part.split(".*") for part in pattern.split("|")]
    if all(_LITERAL.fullmatch(text) for part in found for text in part):
        return found
    return None


def _has(triple: str) -> Column:
    """Is the triple's bit set? (Bit n of the bitmap is bit n % 8 of byte n / 8.)"""
    byte = F.substring("triples", (F.floor(_slot(F.lit(triple)) / 8) + 1).cast("int"), F.lit(1))
    number = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.coalesce(F.getbit(number, (_slot(F.lit(triple)) % 8).cast("int")) == 1, F.lit(False))


def may_hold(since: str | _dt.datetime | None = None, grep: str | None = None, now: _dt.datetime | None = None) -> Column:
    """Can a file of the statistics hold a line of the query?"""
    possible = F.lit(True)
    if since is not None:
        possible &= F.col("max_us").isNotNull() & (F.col("max_us") >= F.unix_micros(since_column(since, now)))
    texts = required_texts(grep) if grep else None
    if texts is not None:
        any_of = F.lit(False)
        for part in texts:
            triples = sorted({text[i:i + 3] for text in part for i in range(len(text) - 2)})
            all_of = F.lit(True)
            for triple in triples:
                all_of &= _has(triple)
            any_of |= all_of
        possible &= any_of
    return possible


def left_out(stats: DataFrame, since: str | _dt.datetime | None = None, grep: str | None = None,
             now: _dt.datetime | None = None) -> DataFrame:
    """(file_origin, file_size) of the files that need not be opened."""
    return stats.where(~may_hold(since, grep, now)).select("file_origin", "file_size")


def write_file_stats(spark: SparkSession, roots: str | list[str], path: str, **options) -> DataFrame:
    """Build the statistics of the trees under ``roots`` and write them to
    ``path``; returns the table read back."""
    from logloom.sources.scan import scan_logs

    file_stats(scan_logs(spark, roots, **options)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
