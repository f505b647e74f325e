"""Helpers shared by the training-data operators.

Documents are identified by ``doc_id``; inside an operator each row also
carries ``rid``, the xxhash64 of (doc_id, text). Rows that repeat both are one
document and get the same result; rows that share only a doc_id stay apart; a
null doc_id is an ordinary value. Only the columns an operator needs are
selected, so extra columns, whatever their names, never reach it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.session import write_and_read

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_SPACE = " \t\n\x0b\x0c\r"
# ASCII letters (lower case) and digits, and every code point beyond ASCII
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NON_WORD_PATTERN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it back: the
    work is done once, survives lost executors, and the reread table's size
    is known to the planner."""
    return write_and_read(df.sparkSession, df, name)


def with_row_key(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, rid, text); a null text becomes the empty text."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), body).alias("rid"), body.alias("text"))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that to pure ASCII and is much
    cheaper than ``translate``, which is needed for other texts only."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, ASCII_UPPER, ASCII_UPPER.lower()))


def words_array(c: Column) -> Column:
    """Lower-cased words (letters, digits and all non-ASCII) of a text, in
    order; an empty array where there are none."""
    pieces = F.split(lower_ascii(c), NON_WORD_PATTERN, -1)
    return F.filter(pieces, lambda w: w != "")
