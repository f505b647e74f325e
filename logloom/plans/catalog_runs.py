"""Registered queries for files, jobs and runs (S1-S8, S15, S16, W1, W2,
G1, G2, J2, P9-P14), over tables derived from ``customer`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import jobs as J
from logloom.functions.parse import iso_timestamp
from logloom.operators import runs as R
from logloom.operators.merge import with_file_order
from logloom.sources import adapter
from logloom.sources.files import classify_files, run_summary


def _ts_iso(c: str):
    return F.when(F.col(c).isNotNull(), iso_timestamp(c))


def q_classify_files(spark, sf_dir):
    f = classify_files(adapter.listing_table(spark, sf_dir), include_log4j=True, include_stacktrace=True)
    return f.select("path", "run_key", "source_type", "app_id", "source_detail", "stream", "is_compressed",
                    "is_active", _ts_iso("file_timestamp").alias("file_ts"))


def q_file_order(spark, sf_dir):
    f = with_file_order(classify_files(adapter.listing_table(spark, sf_dir)))
    return f.select("run_key", "path", "file_idx")


def q_run_summary(spark, sf_dir):
    return run_summary(classify_files(adapter.listing_table(spark, sf_dir)))


def q_file_count(spark, sf_dir):
    f = classify_files(adapter.listing_table(spark, sf_dir), include_log4j=True, include_stacktrace=True)
    return f.groupBy("run_key", "source_type", "stream").agg(F.count(F.lit(1)).alias("n_files"))


def q_parse_job_url(spark, sf_dir):
    u = adapter.urls_table(spark, sf_dir)
    p = J.parse_job_url("url")
    return u.select("url_id", "url", J.is_url("url").alias("is_url"), p["job_id"].alias("job_id"),
                    p["run_id"].alias("run_id"))


def q_job_by_name(spark, sf_dir):
    req = adapter.requests_table(spark, sf_dir).where(~J.is_url("job_input"))
    names = R.jobs_by_name(adapter.jobs_table(spark, sf_dir))
    return req.join(names, req.job_input == names.name, "left").select("request_id", "job_input", "job_id")


def q_run_lookup(spark, sf_dir):
    req = adapter.requests_table(spark, sf_dir).where(F.col("run_id").isNotNull())
    out = R.run_lookup(req, adapter.runs_raw_table(spark, sf_dir), "run_id")
    return out.select("request_id", "run_id", F.col("_run").isNotNull().alias("found"),
                      F.col("_run.start_time").alias("start_time"))


def q_latest_run(spark, sf_dir):
    return R.latest_runs(adapter.runs_raw_table(spark, sf_dir)).select("job_id", "run_id", "start_time")


def q_run_header(spark, sf_dir):
    r = adapter.runs_raw_table(spark, sf_dir)
    return r.select("run_id", J.run_header("start_time", "end_time").alias("header"))


def q_log_destination(spark, sf_dir):
    j = adapter.jobs_table(spark, sf_dir).withColumn("d", J.log_destination("tasks", "job_clusters"))
    return j.select("job_id", F.col("d.destination").alias("destination"), F.col("d.kind").alias("kind"),
                    J.destination_error("job_id", "d").alias("error"))


def q_cluster_id(spark, sf_dir):
    r = adapter.runs_raw_table(spark, sf_dir).withColumn("cid", J.cluster_id("cluster_instance", "tasks"))
    return r.select("run_id", F.col("cid").alias("cluster_id"),
                    F.when(F.col("cid").isNull(), J.no_cluster_error("run_id", "state")).alias("error"))


def q_resolve_runs(spark, sf_dir):
    return R.resolve_runs(adapter.requests_table(spark, sf_dir), adapter.jobs_table(spark, sf_dir),
                          adapter.runs_raw_table(spark, sf_dir))


RUN_QUERIES = {
    "classify_files": q_classify_files,
    "file_order": q_file_order,
    "run_summary": q_run_summary,
    "file_count": q_file_count,
    "parse_job_url": q_parse_job_url,
    "job_by_name": q_job_by_name,
    "run_lookup": q_run_lookup,
    "latest_run": q_latest_run,
    "run_header": q_run_header,
    "log_destination": q_log_destination,
    "cluster_id": q_cluster_id,
    "resolve_runs": q_resolve_runs,
}
