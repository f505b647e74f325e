"""Log file discovery and classification.

A run's log tree is ``<root>/driver/<file>`` and
``<root>/executor/app-<14 digits>-<4 digits>/<N>/<file>``; anything else
(``eventlog/``, ``init_scripts/``, unknown names) is ignored. Classification
is a pure function of the path, written as column expressions, so the same
code labels a listing and the lines of a scan (no join back to the files).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import rules
from logloom.operators.merge import with_file_order
from logloom.sources.byte_files import file_system, readable

# partitions of a listing step, for each core of the cluster
LISTING_TASKS = 2

_DRIVER_REL = r"^(.*)/driver/([^/]+)$"
_EXEC_REL = r"^(.*)/executor/([^/]+)/([^/]+)/([^/]+)$"


def normalize_path(path: Column | str, encoded: bool = False) -> Column:
    """Plain path string: ``file:`` and ``dbfs:`` prefixes stripped (S10) and,
    for URI-encoded input (scan metadata, file index), ``%XX`` decoded.

    ``+`` is literal in a URI path, so it is protected before decoding.
    """
    p = F.col(path) if isinstance(path, str) else path
    if encoded:
        p = F.url_decode(F.replace(p, F.lit("+"), F.lit("%2B")))
    p = F.regexp_replace(p, r"^file:/+", "/")
    return F.regexp_replace(p, r"^dbfs:", "")


# Rule ids: which file-name family a path belongs to.
_DRV_RULES = [
    # (rule id, stream, name pattern, active name or None, stamp template, opt-in)
    (1, "stderr", rules.DRIVER_STDERR, "stderr", "$2-$3-$4 $5:$6", None),
    (2, "stdout", rules.DRIVER_STDOUT, "stdout", "$2-$3-$4 $5:$6", None),
    (3, "log4j", rules.LOG4J_ACTIVE, None, None, "log4j"),
    (4, "log4j", rules.LOG4J_ROTATED, None, "$1-$2-$3 $4:00", "log4j"),
    (5, "stacktrace", rules.STACKTRACE_ACTIVE, None, None, "stacktrace"),
    (6, "stacktrace", rules.STACKTRACE_ROTATED, None, "$1-$2-$3 $4:00", "stacktrace"),
]
_EXE_RULES = [
    (11, "stderr", rules.EXECUTOR_STDERR, "stderr", "$2-$3-$4 $5:00", None),
    (12, "stdout", rules.EXECUTOR_STDOUT, "stdout", "$2-$3-$4 $5:00", None),
]
_STAMP_FORMAT = "yyyy-MM-dd HH:mm"
FILE_FIELDS = ["run_key", "source_type", "app_id", "source_detail", "stream", "is_compressed", "is_active",
               "file_timestamp"]


def _path_pattern(rid: int, name_pattern: str) -> str:
    """Whole-path form of a name pattern: the name must be the last path
    component, under ``driver/`` or ``executor/<app>/<N>/``."""
    body = name_pattern.lstrip("^")
    if rid < 10:
        return "/driver/" + body
    return "/executor/" + rules.APP_DIR.strip("^$") + "/[^/]+/" + body


def _active_rules(include_log4j: bool, include_stacktrace: bool) -> list[tuple]:
    opted = {"log4j": include_log4j, "stacktrace": include_stacktrace}
    return [x for x in _DRV_RULES + _EXE_RULES if x[5] is None or opted[x[5]]]


def is_log_file(path: Column | str, include_log4j: bool = False, include_stacktrace: bool = False) -> Column:
    """One regular expression over the raw path: is it a (selected) log file."""
    p = F.col(path) if isinstance(path, str) else path
    pats = [_path_pattern(x[0], x[2]) for x in _active_rules(include_log4j, include_stacktrace)]
    return p.rlike("(?:" + ")|(?:".join(pats) + ")")


def file_rule(path: Column | str, include_log4j: bool = False, include_stacktrace: bool = False) -> Column:
    """Rule id of a path (null: not a selected log file)."""
    p = F.col(path) if isinstance(path, str) else path
    rule = None
    for rid, _, pat, _, _, _ in _active_rules(include_log4j, include_stacktrace):
        rule = (F.when if rule is None else rule.when)(p.rlike(_path_pattern(rid, pat)), F.lit(rid))
    return rule


def with_file_attributes(df: DataFrame, path_col: str = "path", include_log4j: bool = False,
                         include_stacktrace: bool = False, keep_unknown: bool = False,
                         encoded: bool = False) -> DataFrame:
    """Add the file attributes of ``path_col``; rows that are not log files
    (or opt-in families not asked for) are dropped unless ``keep_unknown``.

    Staged: one combined regex filter on the raw path -> rule id -> parts ->
    attributes, so every regular expression runs once per row and generated
    code stays small even where the filter is pushed down. Rotation times
    are parsed strictly: an impossible date gives null (S7).
    """
    if not keep_unknown:
        df = df.where(is_log_file(path_col, include_log4j, include_stacktrace))
    df = df.withColumn("_rule", file_rule(path_col, include_log4j, include_stacktrace))
    r = F.col("_rule")
    p = normalize_path(path_col, encoded)
    df = df.withColumns({
        "_lp": p,
        "_name": F.regexp_extract(p, r"/([^/]+)$", 1),
    })
    lp, name = F.col("_lp"), F.col("_name")

    stream = compressed = active = stamp = None
    for rid, st, pat, active_name, template, _ in _DRV_RULES + _EXE_RULES:
        hit = r == rid
        if rid > 10:  # executor: optional hourly rotation, optional .gz
            gz, act, rot = name.endswith(".gz"), name == active_name, name.contains("--")
        elif active_name:  # driver stderr/stdout: never compressed
            gz, act = F.lit(False), name == active_name
            rot = ~act
        else:  # log4j / stacktrace: active plain file or rotated .gz
            gz = F.lit(template is not None)
            act, rot = ~gz, gz
        stream = (F.when if stream is None else stream.when)(hit, F.lit(st))
        compressed = (F.when if compressed is None else compressed.when)(hit, gz)
        active = (F.when if active is None else active.when)(hit, act)
        if template is not None:
            stamp = (F.when if stamp is None else stamp.when)(hit & rot, F.regexp_replace(name, pat, template))
    ts = F.try_to_timestamp(F.col("_stamp"), F.lit(_STAMP_FORMAT))
    drv = r < 10
    df = df.withColumn("_stamp", stamp).withColumns({
        "run_key": F.when(drv, F.regexp_extract(lp, _DRIVER_REL, 1)).when(r > 10, F.regexp_extract(lp, _EXEC_REL, 1)),
        "source_type": F.when(drv, F.lit("driver")).when(r > 10, F.lit("executor")),
        "app_id": F.when(r > 10, F.regexp_extract(lp, _EXEC_REL, 2)),
        "source_detail": F.when(drv, F.lit("")).when(r > 10, F.regexp_extract(lp, _EXEC_REL, 3)),
        "stream": stream,
        "is_compressed": compressed,
        "is_active": active,
        "file_timestamp": F.when(~F.col("_stamp").startswith("0000"), ts),
    })
    return df.drop("_lp", "_name", "_rule", "_stamp")


def classify_files(paths: DataFrame, path_col: str = "path", include_log4j: bool = False,
                   include_stacktrace: bool = False) -> DataFrame:
    """Listing (one row per path) -> files table; unknown names dropped."""
    out = with_file_attributes(paths, path_col, include_log4j, include_stacktrace)
    out = out.withColumn(path_col, normalize_path(path_col))
    keep = [x for x in paths.columns if x not in FILE_FIELDS and x != path_col]
    return out.select(F.col(path_col).alias("path"), *FILE_FIELDS, *keep)


def _listed(folders: DataFrame, wanted: str) -> DataFrame:
    """(kind, path, length) of what lies directly in each ``path``, listed by the
    tasks; a folder that does not exist has nothing in it. ``wanted``: ``File`` or
    ``Directory``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch["path"].to_pylist():
                system, base = file_system(folder, encoded=False)
                found = [x for x in system.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if x.type.name == wanted]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{folder}/{x.base_name}" for x in found], pa.string()), pa.array([x.size or 0 for x in found], pa.int64())],
                    ["path", "length"])

    return folders.select("path").mapInArrow(run, "path string, length bigint")


def list_files(spark: SparkSession, roots: str | list[str]) -> DataFrame:
    """All files of the runs under ``roots`` at the depths of log files,
    zero-length ones included: path, length (S1, S9).

    The tasks list: first every run's driver folder and application folders,
    then the executor folders of these, then their files, dealt anew at each
    step. The driver holds the roots it was given, no path. A run that does not
    exist has no files.
    """
    from logloom.sources.scan import plain_root

    roots = [roots] if isinstance(roots, str) else roots
    roots = sorted({plain_root(r): r.rstrip("/") for r in roots if r and r.strip("/")}.values())
    if not all(map(readable, roots)):
        return _indexed_files(spark, roots)
    runs = spark.createDataFrame([(r,) for r in roots], "root string")
    tasks = spark.sparkContext.defaultParallelism

    def dealt(folders: DataFrame) -> DataFrame:
        return folders.select("path").repartition(LISTING_TASKS * tasks, "path")

    driver = _listed(dealt(runs.select(F.concat("root", F.lit("/driver")).alias("path"))), "File")
    apps = _listed(dealt(runs.select(F.concat("root", F.lit("/executor")).alias("path"))), "Directory")
    apps = apps.where(F.regexp_extract("path", "[^/]+$", 0).rlike(rules.APP_DIR))
    executors = _listed(dealt(apps), "Directory")
    files = driver.unionByName(_listed(dealt(executors), "File"))
    return files.select(normalize_path("path").alias("path"), "length")


def _indexed_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """The same from Spark's file index, for stores only Spark can open. Spark
    leaves zero-length files out of a scan, so names come from the index, which
    the driver holds."""
    from logloom.sources.scan import existing_roots, literal_paths

    roots = existing_roots(spark, roots)
    if not roots:
        return spark.createDataFrame([], "path string, length bigint")
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "ignoreMissingFiles", "true").load(literal_paths(roots))
    names = spark.createDataFrame([(p,) for p in scan.inputFiles()], "value string")
    listing = names.select(normalize_path("value", encoded=True).alias("path")).distinct()
    sizes = scan.select(normalize_path("_metadata.file_path", encoded=True).alias("path"),
                        F.col("_metadata.file_size").alias("length"))
    return listing.join(sizes, "path", "left").select("path", F.coalesce("length", F.lit(0)).cast("bigint").alias("length"))


def discover(spark: SparkSession, roots: str | list[str], include_log4j: bool = False,
             include_stacktrace: bool = False) -> DataFrame:
    """Files table of the runs under ``roots``: classified, with file_idx.
    Files at any other depth below a root (a ``driver/`` folder inside another
    folder, say) are no log files of the run."""
    from logloom.sources.scan import plain_root

    roots = [roots] if isinstance(roots, str) else list(roots)
    files = classify_files(list_files(spark, roots), include_log4j=include_log4j,
                           include_stacktrace=include_stacktrace)
    return with_file_order(files.where(F.col("run_key").isin(sorted({plain_root(r) for r in roots}))))


# ------------------------------------------------------------------- G1, G2
def run_summary(files: DataFrame) -> DataFrame:
    """has_driver, has_executor, executor_count, app_id and file count per run.

    ``app_id`` is the lexically last app directory, ``executor_count`` the
    number of (app, executor) directories holding a classified file.
    """
    is_exe = F.col("source_type") == "executor"
    ex = F.when(is_exe, F.concat_ws("/", F.col("app_id"), F.col("source_detail")))
    return files.groupBy("run_key").agg(
        F.bool_or(F.col("source_type") == "driver").alias("has_driver"),
        F.bool_or(is_exe).alias("has_executor"),
        F.countDistinct(ex).cast("int").alias("executor_count"),
        F.max("app_id").alias("app_id"),
        F.count(F.lit(1)).alias("n_files"),
    )
