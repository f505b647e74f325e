"""Line-level column functions: split, blank test, timestamp, level, labels.

All of them are built from native Spark expressions, so they stay inside
whole-stage code generation; none needs a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom import rules


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------- P1/P2
def split_lines(text: Column | str, full: bool = True) -> Column:
    """Array of lines, split like Python ``str.splitlines``.

    ``full=True`` splits on every separator (for whole-file text);
    ``full=False`` only on those the Hadoop line reader leaves in a line.
    """
    t = _col(text)
    if full:
        return F.split(t, rules.LINE_BREAKS)
    # most lines hold none of these rare separators: test with plain
    # substring searches and only run the regex split when one is present
    present = None
    for ch in rules.EXTRA_LINE_BREAKS.strip("[]"):
        present = t.contains(ch) if present is None else present | t.contains(ch)
    return F.when(present, F.split(t, rules.EXTRA_LINE_BREAKS)).otherwise(F.array(t))


def is_non_blank(line: Column | str) -> Column:
    """True when the line has any character that is not whitespace."""
    return _col(line).rlike(rules.NON_BLANK)


# ----------------------------------------------------------------------- P3
# Spark's datetime parser is strict: Feb 30, hour 24 or second 60 give null
# (try_to_timestamp), exactly where strptime raises and the next pattern is
# tried. Its two-digit year reads 00..99 as 2000..2099; the pivot moves
# 69..99 back a century (20yy and 19yy agree on leap years for these).
_FMT_SHORT = "yy/MM/dd HH:mm:ss"
_FMT_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS"
_FMT_LOG4J = "yyyy-MM-dd HH:mm:ss,SSS"


def _try_parse(line: Column, pattern: str, fmt: str) -> Column:
    return F.try_to_timestamp(F.regexp_extract(line, pattern, 1), F.lit(fmt))


def _short_year(line: Column) -> Column:
    ts = _try_parse(line, rules.TS_SHORT_YEAR, _FMT_SHORT)
    pivot = 2000 + rules.SHORT_YEAR_PIVOT
    return F.when(F.year(ts) >= pivot, ts - F.expr("INTERVAL 100 YEARS")).otherwise(ts)


# The bracketed stamp with its offset kept (``honor_offset=True``).
_TS_ISO_BRACKET_OFFSET = r"\[([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}[+\-][0-9]{4})\]"
_FMT_ISO_OFFSET = "yyyy-MM-dd'T'HH:mm:ss.SSSZ"


def parse_timestamp(line: Column | str, honor_offset: bool = False) -> Column:
    """UTC timestamp of the first pattern that matches *and* converts.

    The bracketed ISO stamp's offset is matched and ignored (its wall time
    is taken as UTC) unless ``honor_offset`` converts it to UTC.
    """
    line = _col(line)
    iso = (_try_parse(line, _TS_ISO_BRACKET_OFFSET, _FMT_ISO_OFFSET) if honor_offset
           else _try_parse(line, rules.TS_ISO_BRACKET, _FMT_ISO))
    return F.coalesce(_short_year(line), iso, _try_parse(line, rules.TS_LOG4J, _FMT_LOG4J))


# ----------------------------------------------------------------------- P4
def parse_level(line: Column | str) -> Column:
    """Numeric level of the leftmost whole-word level name, else null."""
    word = F.regexp_extract(_col(line), rules.LEVEL_PATTERN, 1)
    table = F.create_map(*[F.lit(x) for kv in rules.LEVEL_WORDS.items() for x in kv])
    return F.try_element_at(table, word)


def level_numbers(levels: str | list[str] | None) -> list[int] | None:
    """Level names (comma list or list) -> numbers; unknown names are dropped.

    ``None``/empty means "no level filter". A list of only unknown names
    gives an empty list, which selects no rows.
    """
    if levels is None:
        return None
    names = levels.split(",") if isinstance(levels, str) else list(levels)
    if isinstance(levels, str) and not levels:
        return None
    if not names:
        return None
    return sorted({rules.LEVEL_WORDS[n.strip().upper()] for n in names if n.strip().upper() in rules.LEVEL_WORDS})


# ----------------------------------------------------------------------- P6
def source_label(source_type: Column | str = "source_type", source_detail: Column | str = "source_detail",
                 stream: Column | str = "stream") -> Column:
    """``driver:<stream>`` or ``exec/<N>:<stream>``."""
    st, sd, sm = _col(source_type), _col(source_detail), _col(stream)
    return F.when(st == "driver", F.concat(F.lit("driver:"), sm)).otherwise(
        F.concat(F.lit("exec/"), sd, F.lit(":"), sm)
    )


# ----------------------------------------------------------------------- P7
def iso_timestamp(ts: Column | str) -> Column:
    """ISO-8601 with ``+00:00``; six fraction digits only when non-zero."""
    ts = _col(ts)
    frac = F.date_format(ts, "SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(frac == "000000", F.lit("")).otherwise(F.concat(F.lit("."), frac)),
        F.lit("+00:00"),
    )


# ----------------------------------------------------------------------- P8
def level_name(level: Column | str) -> Column:
    lv = _col(level)
    out = None
    for value, name in rules.LEVEL_NAMES.items():
        out = (F.when if out is None else out.when)(lv == value, F.lit(name))
    return out


def parse_entries(lines, honor_offset: bool = False):
    """Add ``timestamp`` and ``level`` parsed from ``line``."""
    return lines.withColumn("timestamp", parse_timestamp("line", honor_offset)).withColumn(
        "level", parse_level("line"))
