"""Job and run lookups as joins.

The single-run lookups of a command line (find a job by name, fetch a run,
take the latest run) become equi-joins against ``jobs`` and ``runs_raw``
tables, so one job resolves a whole table of requests. "Latest" and
"first" are grouped ``max_by``/``min`` with map-side partial aggregation,
never a window over a whole job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions import jobs as J

RUN_FIELDS = ["run_id", "start_time", "end_time", "state", "cluster_instance", "tasks"]


# ---------------------------------------------------------------------- S15
def jobs_by_name(jobs: DataFrame) -> DataFrame:
    """name -> first job (lowest job_id) of that name."""
    return jobs.groupBy("name").agg(F.min("job_id").alias("job_id"))


# ----------------------------------------------------------------------- W1
def latest_runs(runs_raw: DataFrame) -> DataFrame:
    """Latest run of each job: greatest (start_time, run_id)."""
    rec = F.struct(*[F.col(c) for c in RUN_FIELDS])
    order = F.struct(F.col("start_time"), F.col("run_id"))
    return runs_raw.groupBy("job_id").agg(F.max_by(rec, order).alias("r")).select("job_id", "r.*")


# ---------------------------------------------------------------------- S16
def run_lookup(requests: DataFrame, runs_raw: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Attach the run record of ``run_col`` (left join on run id)."""
    r = runs_raw.select(F.col("run_id").alias("_rid"), F.struct(*[F.col(c) for c in RUN_FIELDS]).alias("_run"))
    return requests.join(r, requests[run_col] == r["_rid"], "left").drop("_rid")


# ----------------------------------------------------------------------- J2
RESOLVED = ["request_id", "job_id", "job_name", "run_id", "cluster_id", "env", "base_path", "start_time",
            "end_time", "error"]


def resolve_runs(requests: DataFrame, jobs: DataFrame, runs_raw: DataFrame, all_clusters: bool = False) -> DataFrame:
    """Resolve (job name or URL, optional run id, env) to a run's log path.

    ``requests``: request_id, job_input, run_id (override, nullable), env.
    URLs give the job id (and maybe a run id); names are looked up. An
    explicit run id wins over the URL's; without one (or with 0) the job's
    latest run is used. The first failing step fills ``error`` and leaves
    the other outputs null. With ``all_clusters`` a run whose tasks ran on
    several clusters gives one row per cluster (its own cluster first),
    instead of only the first cluster's log folder.
    """
    url = J.is_url("job_input")
    parsed = J.parse_job_url("job_input")
    by_name = jobs_by_name(jobs).select(F.col("name").alias("_n"), F.col("job_id").alias("_named_id"))
    req = (
        requests.withColumn("_is_url", url)
        .withColumn("_p", F.when(url, parsed))
        .join(by_name, (~F.col("_is_url")) & (F.col("job_input") == F.col("_n")), "left")
        .withColumn("_jid", F.when(F.col("_is_url"), F.col("_p.job_id")).otherwise(F.col("_named_id")))
    )
    j = jobs.select(F.col("job_id").alias("_jj"), F.col("name").alias("_jname"),
                    J.log_destination("tasks", "job_clusters").alias("_dest"))
    req = req.join(j, req["_jid"] == j["_jj"], "left")
    run_id = F.coalesce(F.col("run_id"), F.when(F.col("_is_url"), F.col("_p.run_id")))
    req = req.withColumn("_want", run_id).withColumn("_has_run", F.col("_want").isNotNull() & (F.col("_want") != 0))
    req = run_lookup(req.withColumn("_lookup", F.when(F.col("_has_run"), F.col("_want"))), runs_raw, "_lookup")
    # only jobs that are asked for without a run: their other runs never reach the shuffle
    asked = req.where(~F.col("_has_run") & F.col("_jid").isNotNull()).select(F.col("_jid").alias("job_id")).distinct()
    latest = latest_runs(runs_raw.join(asked, "job_id", "left_semi")).select(F.col("job_id").alias("_lj"), F.struct(*RUN_FIELDS).alias("_latest"))
    req = req.join(latest, (~F.col("_has_run")) & (req["_jid"] == latest["_lj"]), "left")
    run = F.when(F.col("_has_run"), F.col("_run")).otherwise(F.col("_latest"))
    req = req.withColumn("_r", run).withColumn("_cid", J.cluster_id(F.col("_r.cluster_instance"), F.col("_r.tasks")))

    jid_s = F.col("_jid").cast("string")
    error = F.coalesce(
        F.when(F.col("_is_url") & F.col("_p").isNull(),
               F.concat(F.lit("not a job URL: "), F.col("job_input"))),
        F.when(~F.col("_is_url") & F.col("_jid").isNull(),
               F.concat(F.lit("no job is named "), F.col("job_input"))),
        F.when(F.col("_jj").isNull(), F.concat(F.lit("no job has id "), jid_s)),
        J.destination_error(F.col("_jid"), F.col("_dest")),
        F.when(F.col("_has_run") & F.col("_run").isNull(),
               F.concat(F.lit("no run has id "), F.col("_want").cast("string"))),
        F.when(~F.col("_has_run") & F.col("_latest").isNull(),
               F.concat(F.lit("never run: job "), jid_s)),
        F.when(F.col("_cid").isNull(), J.no_cluster_error(F.col("_r.run_id"), F.col("_r.state"))),
    )
    ok = error.isNull()
    if all_clusters:
        clusters = J.all_cluster_ids(F.col("_r.cluster_instance"), F.col("_r.tasks"))
        req = req.withColumn("_cid", F.explode_outer(F.when(F.size(clusters) > 0, clusters)))
    return req.select(
        "request_id",
        F.when(ok, F.col("_jid")).alias("job_id"),
        F.when(ok, F.when(F.col("_is_url"), F.col("_jname")).otherwise(F.col("job_input"))).alias("job_name"),
        F.when(ok, F.col("_r.run_id")).alias("run_id"),
        F.when(ok, F.col("_cid")).alias("cluster_id"),
        F.when(ok, F.col("env")).alias("env"),
        F.when(ok, J.base_path(F.col("_dest.destination"), F.col("_cid"))).alias("base_path"),
        F.when(ok, F.col("_r.start_time")).alias("start_time"),
        F.when(ok, F.col("_r.end_time")).alias("end_time"),
        error.alias("error"),
    )
