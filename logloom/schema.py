"""Table schemas: files, entries, runs, jobs, raw runs."""

from __future__ import annotations

from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("run_key", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("app_id", T.StringType()),
        T.StructField("source_detail", T.StringType()),
        T.StructField("stream", T.StringType()),
        T.StructField("is_compressed", T.BooleanType()),
        T.StructField("is_active", T.BooleanType()),
        T.StructField("file_timestamp", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("file_idx", T.IntegerType()),
    ]
)

ENTRY_COLUMNS = [
    "run_key",
    "source_type",
    "source_detail",
    "stream",
    "timestamp",
    "level",
    "line",
    "file_origin",
    "line_no",
]

RUNS = T.StructType(
    [
        T.StructField("job_id", T.LongType()),
        T.StructField("job_name", T.StringType()),
        T.StructField("run_id", T.LongType()),
        T.StructField("cluster_id", T.StringType()),
        T.StructField("env", T.StringType()),
        T.StructField("base_path", T.StringType()),
        T.StructField("start_time", T.LongType()),
        T.StructField("end_time", T.LongType()),
        T.StructField("has_driver", T.BooleanType()),
        T.StructField("has_executor", T.BooleanType()),
        T.StructField("executor_count", T.IntegerType()),
        T.StructField("app_id", T.StringType()),
    ]
)

_DEST = T.StructType([T.StructField("destination", T.StringType())])
CLUSTER_SPEC = T.StructType(
    [
        T.StructField(
            "new_cluster",
            T.StructType(
                [
                    T.StructField(
                        "cluster_log_conf",
                        T.StructType(
                            [
                                T.StructField("volumes", _DEST),
                                T.StructField("dbfs", _DEST),
                                T.StructField("s3", _DEST),
                            ]
                        ),
                    )
                ]
            ),
        )
    ]
)

JOBS = T.StructType(
    [
        T.StructField("job_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("tasks", T.ArrayType(CLUSTER_SPEC)),
        T.StructField("job_clusters", T.ArrayType(CLUSTER_SPEC)),
    ]
)

_CLUSTER_INSTANCE = T.StructType([T.StructField("cluster_id", T.StringType())])
RUNS_RAW = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("job_id", T.LongType()),
        T.StructField("start_time", T.LongType()),
        T.StructField("end_time", T.LongType()),
        T.StructField("state", T.StructType([T.StructField("life_cycle_state", T.StringType())])),
        T.StructField("cluster_instance", _CLUSTER_INSTANCE),
        T.StructField("tasks", T.ArrayType(T.StructType([T.StructField("cluster_instance", _CLUSTER_INSTANCE)]))),
    ]
)
