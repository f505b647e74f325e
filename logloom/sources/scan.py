"""Reading log trees into entries.

One read path for any number and size of files: the run roots are read with
Spark's text source and every choice (exact depth below a given root, source,
stream, opt-in families) is a predicate on ``_metadata.file_path``, which
prunes files before they are opened. File attributes are derived from the
same path, so no file list passes through the driver and nothing is
broadcast or joined.

Plain files are read line by line (splittable). A gzip archive is inflated in
its task twice, in bounded memory: first to its end, where length and checksum
tell whether it is whole, then for its lines. So a damaged archive is dropped
entirely, like a failed download, while its neighbours are kept, and an archive
may hold any amount of text. ``strict_corrupt=False`` reads gzip files line by
line like plain ones. Files that are gone or unreadable when the query runs are
left out; :func:`skipped_files` reports them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from logloom.functions.parse import is_non_blank, parse_entries, split_lines
from logloom.operators.filters import source_filter, stream_filter
from logloom.sources.byte_files import archive_pieces, archive_text_bytes, lines_of, readable
from logloom.sources.files import normalize_path, with_file_attributes

ENTRY_FIELDS = ["run_key", "source_type", "source_detail", "app_id", "stream", "file_timestamp", "file_origin",
                "line_no", "block_start", "file_size", "is_compressed", "line"]


def plain_root(root: str) -> str:
    """A root in the spelling of ``run_key``: no ``file:`` or ``dbfs:`` prefix,
    no trailing slash."""
    return re.sub(r"^dbfs:", "", re.sub(r"^file:/+", "/", root)).rstrip("/")


def select_files(df: DataFrame, roots: list[str], source: str = "all", stream: str = "all",
                 include_log4j: bool = False, include_stacktrace: bool = False) -> DataFrame:
    """Keep the log files of the given runs that a query reads, with their
    attributes (F1, F2, S1-S8): ``df`` has the scan's path in ``_uri``. A file
    belongs to a run only at its exact depth below the run's root."""
    df = with_file_attributes(df, "_uri", include_log4j, include_stacktrace, encoded=True)
    df = df.where(F.col("run_key").isin(sorted({plain_root(r) for r in roots})) if roots else F.lit(False))
    return source_filter(stream_filter(df, stream), source)


def existing_roots(spark: SparkSession, roots: list[str]) -> list[str]:
    """Run roots that exist, de-duplicated, without roots nested in another
    root (their files would be read twice). A run whose log directory is
    missing yields no files instead of failing the job (S9).

    File-system metadata only: one ``listStatus`` per parent directory
    shared by several roots (a fleet of runs under one job folder is one
    call), ``exists`` for the others.
    """
    clean = {r.rstrip("/") for r in roots if r and r.strip("/")}

    def nested(root: str) -> bool:
        parent = root.rpartition("/")[0]
        while parent:
            if parent in clean:
                return True
            parent = parent.rpartition("/")[0]
        return False

    outer = sorted(r for r in clean if not nested(r))
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
    except Exception:  # no JVM access (e.g. Spark Connect): let the reader decide
        return outer
    by_parent: dict[str, list[str]] = {}
    for r in outer:
        by_parent.setdefault(r.rsplit("/", 1)[0], []).append(r)
    out = []
    for parent, group in by_parent.items():
        if len(group) == 1 or not parent:
            for r in group:
                path = jvm.org.apache.hadoop.fs.Path(r)
                if path.getFileSystem(conf).exists(path):
                    out.append(r)
            continue
        ppath = jvm.org.apache.hadoop.fs.Path(parent)
        fs = ppath.getFileSystem(conf)
        if not fs.exists(ppath):
            continue
        names = {st.getPath().getName() for st in fs.listStatus(ppath) if st.isDirectory()}
        out += [r for r in group if r.rsplit("/", 1)[1] in names]
    return sorted(out)


def literal_paths(roots: list[str]) -> list[str]:
    """Roots as reader paths: their names are no globs."""
    return [re.sub(r"([{}\[\]*?\\])", r"\\\1", r) for r in roots]


def _read(spark: SparkSession, roots: list[str], gz: bool, whole: bool = True) -> DataFrame:
    """Text of the files under ``roots`` with their path; a file that is gone
    or cannot be read gives no rows (or, line by line, those before the damage)."""
    reader = spark.read.option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option(
        "ignoreCorruptFiles", "true")
    if not roots:
        df = spark.createDataFrame([], "value string").withColumn("_metadata", F.struct(
            F.lit("").alias("file_path"), F.lit("").alias("file_name"), F.lit(0).cast("bigint").alias("file_block_start"),
            F.lit(0).cast("bigint").alias("file_size")))
    elif gz and whole:  # a store that only Spark can open: at most 2 GB of text an archive
        df = reader.option("pathGlobFilter", "*.gz").text(literal_paths(roots), wholetext=True)
    elif gz:
        df = reader.option("pathGlobFilter", "*.gz").text(literal_paths(roots))
    else:
        df = reader.text(literal_paths(roots)).where(~F.col("_metadata.file_name").endswith(".gz"))
    return df.select(
        F.make_valid_utf8("value").alias("value"),
        F.col("_metadata.file_path").alias("_uri"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("_metadata.file_size").alias("file_size"),
    )


def _archives(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(_uri, file_size) of the archives under ``roots``, dealt to tasks by size;
    no file body is read."""
    if not roots:
        return spark.createDataFrame([], "_uri string, file_size bigint")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    return reader.option("pathGlobFilter", "*.gz").load(literal_paths(roots)).select(
        F.col("_metadata.file_path").alias("_uri"), F.col("_metadata.file_size").alias("file_size"))


def whole_archives(archives: DataFrame) -> DataFrame:
    """The rows of ``archives`` (``_uri``) whose file is a whole gzip archive."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([archive_text_bytes(uri) is not None for uri in batch["_uri"].to_pylist()], pa.bool_()))

    return archives.mapInArrow(check, archives.schema)


def archive_lines(archives: DataFrame) -> DataFrame:
    """The lines (``value``, split at \\n) of all whole archives, in order, each
    with its archive's columns; none of a damaged one, a blank one of an empty one."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, uri in enumerate(batch["_uri"].to_pylist()):
                if archive_text_bytes(uri) is None:
                    continue
                found = ((lines for _, _, lines in lines_of(archive_pieces(uri))))
                for lines in chain([next(found, [""])], found):  # an archive of no text: one blank line
                    same = pa.array(np.full(len(lines), i))
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(same) for c in batch.columns), pa.array(lines, pa.string())], [*batch.schema.names, "value"])

    return archives.mapInArrow(read, StructType([*archives.schema.fields, StructField("value", StringType())]))


def _lines(plain: DataFrame, packed: DataFrame) -> DataFrame:
    """Split file content into lines and number them.

    What the readers have not split (Hadoop's: \\n, \\r, \\r\\n; the archive
    reader: \\n; none in a whole text) is split here. Lines are numbered after
    the split with monotonically_increasing_id: inside a file split (one
    partition) the number grows with the line, so (split start, number) orders
    a file.
    """
    keep = [*_ATTRS, "_uri", "block_start", "file_size"]
    plain = plain.select(*keep, F.explode(split_lines("value", full=False)).alias("line"))
    breaks = F.col("value").contains("\n") | F.col("value").contains("\r")
    packed = packed.select(*keep, F.explode(
        F.when(breaks, split_lines("value")).otherwise(split_lines("value", full=False))).alias("line"))
    lines = plain.withColumn("_row", F.monotonically_increasing_id()).unionByName(
        packed.withColumn("_row", F.monotonically_increasing_id()))
    return lines.withColumn("line_no", F.struct(F.col("block_start"), F.col("_row").alias("row")))


_ATTRS = ["run_key", "source_type", "app_id", "source_detail", "stream", "file_timestamp", "is_compressed"]


def _without(df: DataFrame, left_out: DataFrame | None) -> DataFrame:
    """Rows of files (``_uri``, ``file_size``) not named in ``left_out``: a
    predicate on file metadata, so those files are not opened."""
    if left_out is None:
        return df
    names = [f"{r.file_origin}\n{r.file_size}" for r in left_out.collect()]
    named = F.concat(normalize_path("_uri", encoded=True), F.lit("\n"), F.col("file_size").cast("string"))
    return df.where(~named.isin(names)) if names else df


def raw_lines(spark: SparkSession, roots: str | list[str], source: str = "all", stream: str = "all",
              include_log4j: bool = False, include_stacktrace: bool = False,
              strict_corrupt: bool = True, left_out: DataFrame | None = None) -> DataFrame:
    """Lines of the selected files with their order key, blank lines kept.

    ``strict_corrupt`` alone decides how gzip files are read, at any size:
    checked to the end first (a damaged archive is dropped), or line by line (a
    damaged archive keeps the lines before the damage).
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    there = existing_roots(spark, roots)
    options = (roots, source, stream, include_log4j, include_stacktrace)
    plain = select_files(_without(_read(spark, there, gz=False), left_out), *options)
    if strict_corrupt and all(map(readable, there)):
        archives = select_files(_without(_archives(spark, there), left_out), *options).withColumn("block_start", F.lit(0).cast("bigint"))
        packed = archive_lines(archives.select(*_ATTRS, "_uri", "block_start", "file_size"))
    else:
        packed = select_files(_without(_read(spark, there, gz=True, whole=strict_corrupt), left_out), *options)
    lines = _lines(plain, packed)
    return lines.withColumn("file_origin", normalize_path("_uri", encoded=True)).select(*ENTRY_FIELDS)


def scan_logs(spark: SparkSession, roots: str | list[str], source: str = "all", stream: str = "all",
              include_log4j: bool = False, include_stacktrace: bool = False, strict_corrupt: bool = True,
              honor_offset: bool = False, left_out: DataFrame | None = None) -> DataFrame:
    """Parsed entries of every selected log file under the run roots, but for
    those named in ``left_out`` (file_origin, file_size; see :mod:`stats`).

    ``line_no`` is a struct (split start, line number in the split's
    partition) ordering lines inside a file; ``block_start`` bounds the
    blocks of the two-level merge.
    """
    lines = raw_lines(spark, roots, source, stream, include_log4j, include_stacktrace, strict_corrupt, left_out)
    return entries_of(lines, honor_offset)


def entries_of(lines: DataFrame, honor_offset: bool = False) -> DataFrame:
    """Parsed entries of raw lines; blank ones are dropped."""
    return parse_entries(lines.where(is_non_blank("line")), honor_offset)


def without_rows(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Non-empty log files of ``files`` of which ``lines`` (:func:`raw_lines`,
    blank ones included) holds none (S14): unreadable, damaged or not gzip."""
    read = lines.select(F.col("file_origin").alias("path")).distinct()
    return files.where(F.col("length") > 0).join(read, "path", "left_anti")


def skipped_files(spark: SparkSession, files: DataFrame, roots: str | list[str],
                  strict_corrupt: bool = True) -> DataFrame:
    """Non-empty log files of ``files`` that give no rows (S14): unreadable,
    damaged or not gzip at all; reads the files for it. Covers plain and gzip files of any size, read
    as the query reads them. (A file that is gone by the time the report reads
    the folder has no size any more and is left out like an empty one.)"""
    roots = [roots] if isinstance(roots, str) else list(roots)
    there = existing_roots(spark, roots)
    if strict_corrupt and all(map(readable, there)):
        packed = whole_archives(_archives(spark, there).select("_uri"))
    else:
        packed = _read(spark, there, gz=True, whole=strict_corrupt).select("_uri")
    read = _read(spark, there, gz=False).select("_uri").unionByName(packed)
    read = read.distinct().select(normalize_path("_uri", encoded=True).alias("path"))
    return files.where(F.col("length") > 0).join(read, "path", "left_anti")
