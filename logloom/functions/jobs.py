"""Column functions over job and run records.

Job settings and runs are nested records (arrays of structs); everything
here is a higher-order column expression (``transform``/``filter``), so one
job resolves any number of jobs and runs in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom import rules


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _truthy(s: Column) -> Column:
    """A non-empty string (Python truthiness of an optional str)."""
    return F.coalesce(s, F.lit("")) != ""


# ---------------------------------------------------------------------- P11
def is_url(text: Column | str) -> Column:
    t = _col(text)
    out = None
    for prefix in rules.URL_PREFIXES:
        hit = t.startswith(prefix)
        out = hit if out is None else out | hit
    return out


# ---------------------------------------------------------------------- P10
def parse_job_url(url: Column | str) -> Column:
    """struct(job_id, run_id) from the first URL shape that matches, else null."""
    u = _col(url)
    out = None
    for pat in rules.URL_PATTERNS:
        job = F.regexp_extract(u, pat, 1).try_cast("bigint")
        run = F.regexp_extract(u, pat, 2).try_cast("bigint") if pat.count("(") == 2 else F.lit(None).cast("bigint")
        rec = F.struct(job.alias("job_id"), run.alias("run_id"))
        out = (F.when if out is None else out.when)(u.rlike(pat), rec)
    return out


# ---------------------------------------------------------------------- P12
def log_destination(tasks: Column | str = "tasks", job_clusters: Column | str = "job_clusters") -> Column:
    """struct(destination, kind) of the first cluster with a log destination.

    Clusters are the tasks' new clusters, then the job clusters'. Within a
    cluster, volumes wins over dbfs over s3. ``kind`` is ``volumes``,
    ``dbfs`` or ``s3``; null when no cluster has a destination. Trailing
    slashes are removed.
    """
    empty = F.array().cast("array<struct<new_cluster:struct<cluster_log_conf:struct<volumes:struct<destination:"
                           "string>,dbfs:struct<destination:string>,s3:struct<destination:string>>>>>")
    specs = F.concat(F.coalesce(_col(tasks), empty), F.coalesce(_col(job_clusters), empty))
    confs = F.transform(specs, lambda s: s["new_cluster"]["cluster_log_conf"])
    usable = F.filter(
        confs,
        lambda c: _truthy(c["volumes"]["destination"]) | _truthy(c["dbfs"]["destination"])
        | _truthy(c["s3"]["destination"]),
    )
    c = F.try_element_at(usable, F.lit(1))
    v, d, s = c["volumes"]["destination"], c["dbfs"]["destination"], c["s3"]["destination"]
    kind = F.when(_truthy(v), F.lit("volumes")).when(_truthy(d), F.lit("dbfs")).when(_truthy(s), F.lit("s3"))
    dest = F.when(_truthy(v), v).when(_truthy(d), d).when(_truthy(s), s)
    return F.struct(F.regexp_replace(dest, "/+$", "").alias("destination"), kind.alias("kind"))


def destination_error(job_id: Column | str, dest: Column | str) -> Column:
    """Error text for a job whose destination cannot be read, else null."""
    d = _col(dest)
    jid = _col(job_id).cast("string")
    return (
        F.when(d["kind"].isNull(), F.concat(F.lit("job "), jid, F.lit(": log delivery is not set up")))
        .when(d["kind"] == "s3", F.concat(F.lit("job "), jid, F.lit(": logs are delivered to S3, which is not read ("),
                                           d["destination"], F.lit(")")))
    )


# ---------------------------------------------------------------------- P13
def cluster_id(cluster_instance: Column | str = "cluster_instance", tasks: Column | str = "tasks") -> Column:
    """The run's own cluster, else the first task's cluster, else null."""
    own = _col(cluster_instance)["cluster_id"]
    ids = F.transform(F.coalesce(_col(tasks), F.array()), lambda t: t["cluster_instance"]["cluster_id"])
    first_task = F.try_element_at(F.filter(ids, lambda x: _truthy(x)), F.lit(1))
    return F.when(_truthy(own), own).otherwise(first_task)


def all_cluster_ids(cluster_instance: Column | str = "cluster_instance", tasks: Column | str = "tasks") -> Column:
    """Every distinct cluster of a run: its own, then its tasks' (in task
    order), empty ids dropped."""
    own = F.array(_col(cluster_instance)["cluster_id"])
    ids = F.transform(F.coalesce(_col(tasks), F.array()), lambda t: t["cluster_instance"]["cluster_id"])
    return F.array_distinct(F.filter(F.concat(own, ids), lambda x: _truthy(x)))


def no_cluster_error(run_id: Column | str, state: Column | str = "state") -> Column:
    life = F.coalesce(_col(state)["life_cycle_state"], F.lit("UNKNOWN"))
    return F.concat(F.lit("run "), _col(run_id).cast("string"), F.lit(": no cluster is known (state "), life,
                    F.lit(")"))


# ---------------------------------------------------------------------- P14
def base_path(destination: Column | str, cluster: Column | str) -> Column:
    return F.concat(_col(destination), F.lit("/"), _col(cluster))


# ----------------------------------------------------------------------- P9
def run_header(start_ms: Column | str = "start_time", end_ms: Column | str = "end_time") -> Column:
    """``Started: unknown`` / ``Started: <UTC> (still running)`` /
    ``Started: <UTC> (1h2m | 3m4s | 5s)``."""
    s, e = _col(start_ms), _col(end_ms)
    start = F.concat(F.date_format(F.timestamp_millis(s), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    # int() truncates the seconds, divmod then floors (as in Python)
    secs = ((e - s) / F.lit(1000)).cast("bigint")
    total_min = F.floor(secs / 60).cast("bigint")
    hours, minutes, seconds = F.floor(total_min / 60).cast("bigint"), F.pmod(total_min, F.lit(60)), F.pmod(secs, F.lit(60))
    dur = (
        F.when(hours != 0, F.concat(hours.cast("string"), F.lit("h"), minutes.cast("string"), F.lit("m")))
        .when(minutes != 0, F.concat(minutes.cast("string"), F.lit("m"), seconds.cast("string"), F.lit("s")))
        .otherwise(F.concat(seconds.cast("string"), F.lit("s")))
    )
    return (
        F.when(s.isNull(), F.lit("Started: unknown"))
        .when(e.isNull(), F.concat(F.lit("Started: "), start, F.lit(" (still running)")))
        .otherwise(F.concat(F.lit("Started: "), start, F.lit(" ("), dur, F.lit(")")))
    )
