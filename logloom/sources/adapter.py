"""Log-shaped tables derived from the driver's parquet tables.

None of the benchmark tables holds log text, so ``events`` is rendered as
log lines (one line per event) and the operators parse that text back. The
rules are deterministic column expressions, so the same table can be built
in SQL for the oracle. All work is per row and narrow: the adapter adds no
shuffle and grows linearly with ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.parse import split_lines

# FIXED VALUES: adapter vocabulary
APP_ID = "app-20240101000000-0000"
LEVEL_WORD_BY_EVENT = {"error": "ERROR", "purchase": "WARN", "signup": "WARNING", "view": "INFO", "click": "DEBUG"}
NOISE_MESSAGE = "Executor: Finished task "
MESSAGES_BY_EVENT_MOD_11 = {
    1: "java.lang.OutOfMemoryError: Java heap space, user ",
    2: "TransportChannelHandler: Connection refused by peer, user ",
    3: "HangingTaskDetector: task is probably not making progress, user ",
    4: "AnalysisException: column not found, user ",
    5: "SparkException: Job aborted due to stage failure, user ",
    6: "Py4JJavaError: An error occurred while calling o42, user ",
    7: "RESOURCE_DOES_NOT_EXIST: table is missing, user ",
    8: "FileAlreadyExistsException: part file exists, user ",
}
DEFAULT_MESSAGE = "MyApp: processed record of user "
STACK_LINE = "    at app//com.x.Foo.run(Foo.scala:1)"
TRACEBACK_LINE = "Traceback (most recent call last):"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, spread over the cluster's cores when its scan has
    fewer partitions than cores (a small single-row-group file would
    otherwise parse every line in one task). Large tables already scan in
    many splits and are left alone: no extra shuffle at scale."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    try:
        cores = spark.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
    except Exception:  # no RDD access (e.g. a Spark Connect session): leave as is
        return df
    return df.repartition(cores) if parts < cores else df


def _case(key: Column, mapping: dict, default=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when if out is None else out.when)(key == F.lit(k), F.lit(v))
    return out if default is None else out.otherwise(default)


def render_events(events: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """events -> raw log lines with file attributes (no parsing yet).

    Output: run_key, source_type, source_detail, app_id, stream, file_origin,
    line_no, line.
    """
    eid, uid, ts = F.col("event_id"), F.col("user_id"), F.col("ts")
    is_driver = uid % 5 == 0
    source_detail = F.when(is_driver, F.lit("")).otherwise((uid % 5 - 1).cast("string"))
    run_key = F.concat(F.lit("run-"), (uid % 4).cast("string"))
    stream = F.when(eid % 3 == 0, F.lit("stdout")).otherwise(F.lit("stderr"))
    k8 = eid % 8
    stamp = (
        F.when(k8 == 3, F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+0200]")))
        .when(k8 == 4, F.date_format(ts, "yyyy-MM-dd HH:mm:ss,SSS"))
        .otherwise(F.date_format(ts, "yy/MM/dd HH:mm:ss"))
    )
    message = F.when(k8 == 6, F.lit(NOISE_MESSAGE)).otherwise(
        _case(eid % 11, MESSAGES_BY_EVENT_MOD_11, F.lit(DEFAULT_MESSAGE))
    )
    text = F.concat_ws(" ", stamp, _case(F.col("event_type"), LEVEL_WORD_BY_EVENT), F.concat(message, uid.cast("string")))
    record = F.when(k8 == 5, F.when(eid % 2 == 0, F.lit(STACK_LINE)).otherwise(F.lit(TRACEBACK_LINE))).otherwise(text)
    # Each rendered record goes through the same line split (P1) as file
    # content, so ``line`` is a column of its own, like in a file scan.
    out = events.select(
        run_key.alias("run_key"),
        F.when(is_driver, F.lit("driver")).otherwise(F.lit("executor")).alias("source_type"),
        source_detail.alias("source_detail"),
        F.when(is_driver, F.lit(None).cast("string")).otherwise(F.lit(APP_ID)).alias("app_id"),
        stream.alias("stream"),
        eid.alias("line_no"),
        F.explode(split_lines(record)).alias("line"),
        *[F.col(c) for c in extra],
    )
    file_origin = F.when(
        F.col("source_type") == "driver",
        F.concat(F.lit("/logs/"), F.col("run_key"), F.lit("/driver/"), F.col("stream")),
    ).otherwise(
        F.concat(
            F.lit("/logs/"), F.col("run_key"), F.lit(f"/executor/{APP_ID}/"), F.col("source_detail"),
            F.lit("/"), F.col("stream"),
        )
    )
    return out.withColumn("file_origin", file_origin).withColumn(
        "file_timestamp", F.lit(None).cast("timestamp")
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw log lines rendered from ``events`` of ``sf_dir``."""
    return render_events(read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"))


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed entries (timestamp, level) from ``events`` of ``sf_dir``."""
    from logloom.functions.parse import parse_entries

    return parse_entries(log_lines(spark, sf_dir))


# ---------------------------------------------------------------------------
# Jobs, runs, URLs, resolve requests and file names from customer / orders
# ---------------------------------------------------------------------------
# FIXED VALUES: adapter vocabulary for jobs and runs
HOST = "https://dbc-1.cloud.example.com"
VOLUME_ROOT = "/Volumes/main/logs/"
NATION_VOLUME_ROOT = "/Volumes/main/nation/"
SHARED_VOLUME_ROOT = "/Volumes/shared/jc/"
DBFS_ROOT = "dbfs:/cluster-logs/"
NATION_DBFS_ROOT = "dbfs:/nation-logs/"
S3_ROOT = "s3://logs-bucket/"
LOG_ROOT = "/mnt/logs/run-"
ENVS = {0: "prod", 1: "staging", 2: "ondemand"}
LIFE_CYCLE = {"F": "TERMINATED", "O": "RUNNING"}
OTHER_LIFE_CYCLE = "PENDING"


_LOG_CONF_TYPE = ("struct<volumes:struct<destination:string>,dbfs:struct<destination:string>,"
                  "s3:struct<destination:string>>")


def _s(c: Column) -> Column:
    return c.cast("string")


def _conf(volumes: Column | None = None, dbfs: Column | None = None, s3: Column | None = None) -> Column:
    def dest(x: Column | None) -> Column:
        return F.struct(x.alias("destination")) if x is not None else F.lit(None).cast("struct<destination:string>")

    return F.struct(F.struct(dest(volumes).alias("volumes"), dest(dbfs).alias("dbfs"), dest(s3).alias("s3"))
                    .alias("cluster_log_conf"))


def jobs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per customer: job_id = c_custkey, name = c_name, two tasks and
    an optional job cluster whose log configuration follows from the keys."""
    from logloom.schema import CLUSTER_SPEC

    c = read_table(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    none = F.lit(None).cast(CLUSTER_SPEC["new_cluster"].dataType.simpleString())
    first = (
        F.when(key % 5 == 0, none)
        .when(key % 5 == 1, F.struct(F.lit(None).cast(_LOG_CONF_TYPE).alias("cluster_log_conf")))
        .when(key % 5 == 2, _conf(volumes=F.concat(F.lit(VOLUME_ROOT), F.lower("c_mktsegment"), F.lit("/"))))
        .when(key % 5 == 3, _conf(dbfs=F.concat(F.lit(DBFS_ROOT), _s(key))))
        .otherwise(_conf(s3=F.concat(F.lit(S3_ROOT), _s(key), F.lit("//"))))
    )
    second = (
        F.when(nation % 4 == 0, _conf(volumes=F.concat(F.lit(NATION_VOLUME_ROOT), _s(nation))))
        .when(nation % 4 == 1, _conf(dbfs=F.concat(F.lit(NATION_DBFS_ROOT), _s(nation), F.lit("/"))))
        .when(nation % 4 == 2, _conf(volumes=F.lit("")))
        .otherwise(none)
    )
    shared = F.array(F.struct(_conf(volumes=F.concat(F.lit(SHARED_VOLUME_ROOT), _s(key % 10))).alias("new_cluster")))
    empty = F.array().cast(f"array<{CLUSTER_SPEC.simpleString()}>")
    return c.select(
        key.alias("job_id"),
        F.col("c_name").alias("name"),
        F.array(F.struct(first.alias("new_cluster")), F.struct(second.alias("new_cluster"))).alias("tasks"),
        F.when(key % 2 == 0, shared).otherwise(empty).alias("job_clusters"),
    )


def runs_raw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per order: run_id = o_orderkey, job_id = o_custkey, times
    from o_orderdate, and a cluster on the run, on a task, or nowhere."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    start = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + (k % 86400) * 1000
    end = F.when(F.col("o_orderstatus") == "O", F.lit(None).cast("bigint")).otherwise(
        start + (k * 7919 % 20000) * 1000 + k % 1000
    )
    state = _case(F.col("o_orderstatus"), LIFE_CYCLE, F.lit(OTHER_LIFE_CYCLE))
    cid = F.concat(F.lit("0101-"), F.lpad(_s(k), 6, "0"))

    def task(x: Column | None) -> Column:
        ci = F.struct(x.alias("cluster_id")) if x is not None else F.lit(None).cast("struct<cluster_id:string>")
        return F.struct(ci.alias("cluster_instance"))

    k10 = k % 10
    tasks = (
        F.when(k10 == 7, F.array(task(None), task(F.concat(cid, F.lit("-t2")))))
        .when(k10 == 8, F.array(task(F.lit("")), task(F.concat(cid, F.lit("-t2")))))
        .when(k10 == 9, F.array().cast("array<struct<cluster_instance:struct<cluster_id:string>>>"))
        .otherwise(F.array(task(F.concat(cid, F.lit("-t1")))))
    )
    own = F.when(k10 < 7, F.struct(F.concat(cid, F.lit("-ci")).alias("cluster_id")))
    return o.select(
        k.alias("run_id"),
        F.col("o_custkey").alias("job_id"),
        start.alias("start_time"),
        end.alias("end_time"),
        F.struct(state.alias("life_cycle_state")).alias("state"),
        own.alias("cluster_instance"),
        tasks.alias("tasks"),
    )


def urls_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workspace URLs (and non-URLs) in every supported shape, one per order."""
    o = read_table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    k6 = k % 6
    url = (
        F.when(k6 == 0, F.concat(F.lit(HOST + "/jobs/"), _s(c), F.lit("/runs/"), _s(k)))
        .when(k6 == 1, F.concat(F.lit(HOST + "/jobs/"), _s(c)))
        .when(k6 == 2, F.concat(F.lit(HOST + "/?o=1#job/"), _s(c), F.lit("/run/"), _s(k)))
        .when(k6 == 3, F.concat(F.lit(HOST.replace("https", "http") + "/#job/"), _s(c)))
        .when(k6 == 4, F.concat(F.lit(HOST + "/clusters/"), _s(k)))
        .otherwise(F.concat(F.lit("Customer#"), F.lpad(_s(c), 9, "0")))
    )
    return o.select(k.alias("url_id"), url.alias("url"))


def requests_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolve requests, one per order: by name, by URL (with or without a
    run), by name with an explicit run id, or for a job that does not exist."""
    o = read_table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat(F.lit("Customer#"), F.lpad(_s(c), 9, "0"))
    k5 = k % 5
    job_input = (
        F.when(k5 == 1, F.concat(F.lit(HOST + "/jobs/"), _s(c), F.lit("/runs/"), _s(k)))
        .when(k5 == 2, F.concat(F.lit(HOST + "/#job/"), _s(c)))
        .when(k5 == 4, F.concat(F.lit(HOST + "/jobs/"), _s(c + 100000)))
        .otherwise(name)
    )
    return o.select(
        k.alias("request_id"),
        job_input.alias("job_input"),
        F.when(k5 == 3, k).alias("run_id"),
        _case(k % 3, ENVS).alias("env"),
    )


def listing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File paths of log trees, one per order (duplicates removed): driver and
    executor files in every naming shape, plus names that must be ignored."""
    o = read_table(spark, sf_dir, "orders")
    k, c, d = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    # name parts first, as columns, so each is computed once per row
    o = o.select(
        k.alias("k"),
        F.concat(F.lit(LOG_ROOT), _s(c % 50)).alias("root"),
        F.date_format(d, "yyyy-MM-dd").alias("ymd"),
        F.date_format(d, "yyyy").alias("year"),
        F.lpad(_s(k % 24), 2, "0").alias("hh"),
        F.lpad(_s(k % 60), 2, "0").alias("mm"),
        F.when(k % 17 == 0, F.lit("app-bad")).otherwise(
            F.concat(F.lit("app-"), F.date_format(d, "yyyyMMdd"), F.lit("000000-"), F.lpad(_s(c % 3), 4, "0"))
        ).alias("app"),
        F.when(k % 31 == 0, F.concat(F.lit("x"), _s(k % 5))).otherwise(_s(k % 13)).alias("execnum"),
        F.floor(k / 3).alias("v"),
    )
    k, root, ymd, year, hh, mm, v = (F.col(x) for x in ("k", "root", "ymd", "year", "hh", "mm", "v"))
    drv = [
        F.lit("stderr"),
        F.lit("stdout"),
        F.concat(F.lit("stderr--"), ymd, F.lit("--"), hh, F.lit("-"), mm),
        F.concat(F.lit("stdout--"), ymd, F.lit("--"), hh, mm),
        F.lit("log4j-active.log"),
        F.concat(F.lit("log4j-"), ymd, F.lit("-"), hh, F.lit(".log.gz")),
        F.lit("stacktrace.log"),
        F.concat(ymd, F.lit("-"), hh, F.lit(".stacktrace.log.gz")),
        F.lit("stderr.gz"),
        F.concat(F.lit("stderr--"), year, F.lit("-02-30--10-00")),
        F.concat(F.lit("stdout--"), ymd, F.lit("--24-"), mm),
        F.lit("notes.txt"),
    ]
    exe = [
        F.lit("stderr"),
        F.lit("stdout"),
        F.concat(F.lit("stderr--"), ymd, F.lit("--"), hh),
        F.concat(F.lit("stdout--"), ymd, F.lit("--"), hh, F.lit(".gz")),
        F.lit("stderr.gz"),
        F.concat(F.lit("stderr--"), ymd, F.lit("--"), hh, F.lit(".gz")),
        F.concat(F.lit("stdout--"), year, F.lit("-13-01--05")),
        F.lit("core.dump"),
    ]

    def pick(names: list[Column], idx: Column) -> Column:
        out = None
        for i, n in enumerate(names):
            out = (F.when if out is None else out.when)(idx == i, n)
        return out

    app, execnum = F.col("app"), F.col("execnum")
    path = (
        F.when(k % 23 == 0, F.concat(root, F.lit("/eventlog/app/eventlog")))
        .when(k % 29 == 0, F.concat(root, F.lit("/init_scripts/init.sh")))
        .when(k % 3 == 0, F.concat(root, F.lit("/driver/"), pick(drv, v % 12)))
        .otherwise(F.concat(root, F.lit("/executor/"), app, F.lit("/"), execnum, F.lit("/"), pick(exe, v % 8)))
    )
    return o.select(path.alias("path")).distinct()


# ---------------------------------------------------------------------------
# A real log tree written from events (for the file-scan path)
# ---------------------------------------------------------------------------
TREE_DIR = "logloom-trees"
N_RUNS = 4
# Executor files of every GZ_EVERY-th day are gzipped; on DAMAGED_DAY one
# file of that name holds plain text, so it is no archive and is dropped whole.
GZ_EVERY = 4
ROTATED_DRIVER, ROTATED_EXECUTOR = "--2024-12-31--23-59", "--2024-12-31--23"
DAMAGED_DAY, DAMAGED_RUN, DAMAGED_SOURCE, DAMAGED_STREAM = 8, "run-0", "0", "stderr"


def tree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered lines with their file (``rel``) in a tree that rotates daily,
    whatever the amount of data, and how it is to be written (``packed``)."""
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    lines = render_events(events, extra=("ts",))
    stamp = F.concat(F.lit("--"), F.date_format("ts", "yyyy-MM-dd"), F.lit("--00"))
    executor = F.col("source_type") == "executor"
    named_gz = executor & (F.dayofmonth("ts") % GZ_EVERY == 0)
    damaged = (named_gz & (F.dayofmonth("ts") == DAMAGED_DAY) & (F.col("run_key") == DAMAGED_RUN)
               & (F.col("source_detail") == DAMAGED_SOURCE) & (F.col("stream") == DAMAGED_STREAM))
    driver_file = F.concat(F.col("run_key"), F.lit("/driver/"), F.col("stream"), stamp, F.lit("-00"))
    executor_file = F.concat(F.col("run_key"), F.lit(f"/executor/{APP_ID}/"), F.col("source_detail"), F.lit("/"),
                             F.col("stream"), stamp, F.when(named_gz, ".gz").otherwise(""))
    return lines.select("line_no", "line", F.when(executor, executor_file).otherwise(driver_file).alias("rel"),
                        (named_gz & ~damaged).alias("packed"))


def write_log_files(lines: DataFrame, base: str) -> None:
    """Write (rel, packed, line_no, line) as files below ``base``: each by the
    task that holds its lines, in order, under its own name, line by line. A
    task that is run again writes the same files again."""
    def write(batches):
        import gzip

        import pyarrow as pa
        from pyarrow import fs as pafs

        from logloom.sources.byte_files import file_system

        name, out, done = None, None, 0
        for batch in batches:
            start = 0
            rels, packed, text = (batch[c].to_pylist() for c in ("rel", "packed", "line"))
            while start < len(rels):
                stop = next((i for i in range(start + 1, len(rels)) if rels[i] != rels[start]), len(rels))
                if rels[start] != name:
                    if out is not None:
                        out.close()
                    name, done = rels[start], done + 1
                    system, path = file_system(f"{base}/{name}", encoded=False)
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                    if packed[start]:
                        out = gzip.GzipFile(fileobj=pa.PythonFile(out, "w"), mode="wb", compresslevel=6, mtime=0)
                out.write(("\n".join(text[start:stop]) + "\n").encode())
                start = stop
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["files"])

    lines.select("rel", "packed", "line_no", "line").repartition("rel").sortWithinPartitions("rel", "line_no").mapInArrow(
        write, "files long").agg(F.sum("files")).collect()


def materialize_log_tree(spark: SparkSession, sf_dir: str) -> list[str]:
    """Write ``events`` as a log tree (daily files per run, source and stream,
    plain and gzipped, lines in event order) under a new folder of the
    session's checkpoint folder and return the run roots. Every call reads
    ``events`` and writes anew."""
    import uuid

    from logloom.session import ensure_checkpoint_dir

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{TREE_DIR}/{uuid.uuid4().hex[:12]}"
    write_log_files(tree_lines(spark, sf_dir), base)
    return [f"{base}/run-{i}" for i in range(N_RUNS)]


GROWTH_STEPS = 3


def growing_tree(spark: SparkSession, sf_dir: str):
    """(root folder, run roots, steps): a tree whose active files grow: calling
    steps[k] writes the first (k + 1) thirds of ``events``; the last one, all of
    them, and the files bear the names they are rotated to."""
    import uuid

    from pyarrow import fs as pafs

    from logloom.session import ensure_checkpoint_dir
    from logloom.sources.byte_files import file_system

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{TREE_DIR}/{uuid.uuid4().hex[:12]}"
    lines = render_events(read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"))
    lines = lines.withColumn("rel", F.regexp_replace("file_origin", "^/logs/", "")).withColumn("packed", F.lit(False))
    low, high = lines.agg(F.min("line_no"), F.max("line_no")).first()

    def step(k: int) -> None:
        if k == GROWTH_STEPS - 1:
            system, path = file_system(base, encoded=False)
            for info in system.get_file_info(pafs.FileSelector(path, allow_not_found=True, recursive=True)):
                if info.type == pafs.FileType.File:
                    system.move(info.path, info.path + ROTATED_DRIVER * ("/driver/" in info.path) + ROTATED_EXECUTOR * ("/executor/" in info.path))
        done = k == GROWTH_STEPS - 1
        rotated = F.concat("rel", F.when(F.col("source_type") == "driver", ROTATED_DRIVER).otherwise(ROTATED_EXECUTOR))
        part = lines.where(F.col("line_no") <= low + (high - low) * (k + 1) // GROWTH_STEPS)
        write_log_files(part.withColumn("rel", rotated) if done else part, base)

    return base, [f"{base}/run-{i}" for i in range(N_RUNS)], [lambda k=k: step(k) for k in range(GROWTH_STEPS)]
