"""Line dedup: drop every line whose key occurs in many documents.

A line's key is the line without ASCII white space at either end, A-Z
lower-cased. Hashes of the keys (128 bits) are range-partitioned by (hash,
document) and sorted by document and position, so one hot line spreads over
as many partitions as its documents need; the first occurrence per document
is streamed off that order and summed per hash. The result is one
run-length-compressed keep bitmap per document that loses lines, no text;
:func:`apply_keep_runs` cuts the texts with it.

Defined results: a null or empty text is one empty line, which is never
dropped (its key is shorter than ``min_chars``); rows repeating doc_id and
text count as one document; ties do not arise, as all lines of a frequent key
go; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import ASCII_SPACE, lower_ascii, materialise, with_row_key

KEEP_RUNS = "array<struct<start:int,length:int>>"


def line_occurrences(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h1, h2, rid, pos, n_lines, first_in_doc), range-partitioned by hash and
    document and sorted by (hash, document, position)."""
    lines = with_row_key(docs).select("rid", F.split("text", "\n", -1).alias("lines"))
    lines = lines.select("rid", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    key = lower_ascii(F.btrim("line", F.lit(ASCII_SPACE)))
    hashed = (lines.select("rid", "pos", "n_lines", key.alias("key"))
              .where(F.char_length("key") >= min_chars)
              .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"),
                      "rid", "pos", "n_lines"))
    ranged = hashed.repartitionByRange("h1", "rid").sortWithinPartitions("h1", "rid", "h2", "pos")
    order = Window.partitionBy("h1", "rid", "h2").orderBy("pos")
    return ranged.withColumn("first_in_doc", F.row_number().over(order) == 1)


def frequent_hashes(occurrences: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2) of keys found in ``min_docs`` documents or more."""
    firsts = occurrences.where("first_in_doc").groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
    return firsts.where(F.col("n_docs") >= min_docs).select("h1", "h2")


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(rid, n_dropped, keep_runs) for every document that loses lines; a
    document without a row keeps all of them. ``keep_runs`` is the keep
    bitmap over its lines, run-length compressed: the runs of ones."""
    occurrences = materialise(line_occurrences(docs, min_chars), "line_occurrences")
    frequent = materialise(frequent_hashes(occurrences, min_docs), "frequent_lines")
    gone = occurrences.join(frequent, ["h1", "h2"]).select("rid", "pos", "n_lines").distinct()
    per_doc = gone.groupBy("rid").agg(F.sort_array(F.collect_list("pos")).alias("dropped"),
                                      F.first("n_lines").alias("n_lines"))
    bounds = F.concat(F.array(F.lit(-1)), F.col("dropped"), F.array(F.col("n_lines")))
    gaps = F.zip_with(
        F.slice("bounds", 1, F.size("bounds") - 1), F.slice("bounds", 2, F.size("bounds") - 1),
        lambda a, b: F.struct((a + 1).cast("int").alias("start"), (b - a - 1).cast("int").alias("length")))
    return (per_doc.withColumn("bounds", bounds)
            .select("rid", F.size("dropped").cast("long").alias("n_dropped"),
                    F.filter(gaps, lambda r: r["length"] > 0).alias("keep_runs")))


def apply_keep_runs(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, rid, n_lines, n_dropped, kept_text) for every document."""
    joined = with_row_key(docs).join(bitmaps, "rid", "left").withColumn("lines", F.split("text", "\n", -1))
    kept = F.flatten(F.transform("keep_runs", lambda r: F.slice(F.col("lines"), r["start"] + 1, r["length"])))
    return joined.select(
        "doc_id", "rid", F.size("lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("keep_runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Documents with their frequent lines removed, see :func:`apply_keep_runs`."""
    return apply_keep_runs(docs, keep_bitmaps(docs, min_docs, min_chars))
