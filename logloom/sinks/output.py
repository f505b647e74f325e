"""Text and JSON-lines renderings of entries, and the writer (K1-K3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.parse import iso_timestamp, level_name, source_label
from logloom.operators.merge import merge_sort_cols, with_merge_keys

LABEL_WIDTH = 12
BLANK_TIME = " " * 19


# ----------------------------------------------------------------------- K1
def text_line() -> Column:
    """``[<label, padded to 12> <yyyy-MM-ddTHH:mm:ss or 19 blanks>] <line>``.

    ``rpad`` truncates, so the width is never below the label's length.
    """
    label = source_label()
    padded = F.rpad(label, F.greatest(F.lit(LABEL_WIDTH), F.length(label)), " ")
    stamp = F.coalesce(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(BLANK_TIME))
    return F.concat(F.lit("["), padded, F.lit(" "), stamp, F.lit("] "), F.col("line"))


# ----------------------------------------------------------------------- K2
def _json_value(c: Column) -> Column:
    """JSON encoding of one scalar (string or null), via ``to_json`` of a
    one-element array with the brackets cut off."""
    arr = F.to_json(F.array(c))
    return F.substring(arr, F.lit(2), F.length(arr) - 2)


JSON_KEYS = ["source_type", "source_detail", "stream", "timestamp", "level", "file", "line"]


# Control characters whose backslash-u00XX escape contains a letter; Spark's JSON
# writer prints the hex in upper case, Python's json.dumps in lower case.
_UPPER_HEX_ESCAPES = ["0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"]


def _lower_hex_escapes(j: Column) -> Column:
    r"""``\u001B`` -> ``\u001b`` for real escapes only (an even run of
    backslashes before it); applied only to lines that contain one."""
    fixed = j
    for code in _UPPER_HEX_ESCAPES:
        fixed = F.regexp_replace(fixed, r"(?<!\\)((?:\\\\)*)\\u00" + code, r"$1\\u00" + code.lower())
    return F.when(j.contains("\\u00"), fixed).otherwise(j)  # plain substring test first


def jsonl_line() -> Column:
    r"""One JSON object per entry, keys in fixed order, nulls kept, written
    byte for byte like Python's ``json.dumps(..., ensure_ascii=False)``
    (``", "`` / ``": "`` separators, lower-case ``\u00xx`` escapes)."""
    values = {
        "source_type": F.col("source_type"),
        "source_detail": F.col("source_detail"),
        "stream": F.col("stream"),
        "timestamp": F.when(F.col("timestamp").isNotNull(), iso_timestamp("timestamp")),
        "level": level_name("level"),
        "file": F.col("file_origin"),
        "line": F.col("line"),
    }
    parts: list[Column] = [F.lit("{")]
    for i, k in enumerate(JSON_KEYS):
        parts += [F.lit(("" if i == 0 else ", ") + f'"{k}": '), _json_value(values[k].cast("string"))]
    parts.append(F.lit("}"))
    return _lower_hex_escapes(F.concat(*parts))


# ----------------------------------------------------------------------- K3
def render(df: DataFrame, fmt: str = "text") -> Column:
    return jsonl_line() if fmt == "jsonl" else text_line()


def write_entries(df: DataFrame, path: str, fmt: str = "text", ordered: bool = True, mode: str = "overwrite",
                  order_col: str = "line_no") -> None:
    """Write entries as text or JSON lines.

    Ordered output is a range-partitioned sort: part files sorted by name
    hold consecutive slices of the merged order (no single-task collect).
    """
    out = df
    if ordered:
        if "merge_ts" not in out.columns:
            out = with_merge_keys(out, order_col=order_col)
        out = out.orderBy(*merge_sort_cols(order_col))
    out.select(render(out, fmt).alias("value")).write.mode(mode).text(path)
