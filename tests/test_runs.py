"""Job and run lookups."""

import pytest
from pyspark.sql import functions as F

from logloom.functions import jobs as J
from logloom.operators import runs as R
from logloom.schema import JOBS, RUNS_RAW

URLS = [
    ("https://dbc-x.cloud.example.com/jobs/12345/runs/67890", 12345, 67890),
    ("https://dbc-x.cloud.example.com/jobs/12345", 12345, None),
    ("https://dbc-x.cloud.example.com/?o=1#job/12345/run/67890", 12345, 67890),
    ("https://dbc-x.cloud.example.com/#job/12345", 12345, None),
    ("https://x/jobs/12345/runs/67890?tab=logs", 12345, 67890),
    ("http://x/jobs/7/runs/abc", 7, None),
]


def test_parse_url(spark):
    df = spark.createDataFrame([(u,) for u, _, _ in URLS] + [("https://x/clusters/1",), ("my-job",)], "u string")
    rows = df.select(J.parse_job_url("u").alias("p"), J.is_url("u").alias("i")).collect()
    for (u, job, run), r in zip(URLS, rows):
        assert (r.p.job_id, r.p.run_id) == (job, run), u
        assert r.i
    assert rows[-2].p is None and rows[-2].i
    assert rows[-1].p is None and not rows[-1].i


def conf(v=None, d=None, s=None):
    mk = lambda x: None if x is None else {"destination": x}
    return {"new_cluster": {"cluster_log_conf": {"volumes": mk(v), "dbfs": mk(d), "s3": mk(s)}}}


def test_log_destination(spark):
    jobs = [
        (1, "a", [conf(d="dbfs:/logs/a/"), conf(v="/Volumes/x")], []),  # first cluster with any destination wins
        (2, "b", [{"new_cluster": None}, conf(v="")], [conf(v="/Volumes/jc//")]),
        (3, "c", [conf(s="s3://b/x/")], []),
        (4, "d", [conf()], None),
    ]
    df = spark.createDataFrame(jobs, JOBS).select("job_id", J.log_destination().alias("d"))
    got = {r.job_id: (r.d.destination, r.d.kind) for r in df.collect()}
    assert got == {1: ("dbfs:/logs/a", "dbfs"), 2: ("/Volumes/jc", "volumes"), 3: ("s3://b/x", "s3"), 4: (None, None)}


def run(rid, job, start, end=None, own=None, tasks=(), state="TERMINATED"):
    return (rid, job, start, end, {"life_cycle_state": state}, None if own is None else {"cluster_id": own},
            [{"cluster_instance": None if t is None else {"cluster_id": t}} for t in tasks])


@pytest.fixture
def runs(spark):
    return spark.createDataFrame([
        run(10, 1, 1000, 5000, own="c-10"),
        run(11, 1, 9000, None, tasks=[None, "", "c-11"]),
        run(12, 2, 100, 200, tasks=[], state="PENDING"),
        run(13, 2, 50, 60, own="c-13"),
    ], RUNS_RAW)


def test_cluster_id(runs):
    got = {r.run_id: (r.c, r.e) for r in runs.select(
        "run_id", J.cluster_id().alias("c"), J.no_cluster_error("run_id").alias("e")).collect()}
    assert got[10][0] == "c-10" and got[11][0] == "c-11" and got[12][0] is None
    assert got[12][1] == "run 12: no cluster is known (state PENDING)"


def test_latest(runs):
    got = {r.job_id: r.run_id for r in R.latest_runs(runs).collect()}
    assert got == {1: 11, 2: 12}


def test_run_header(spark):
    df = spark.createDataFrame([(None, None), (0, None), (0, 3723000), (0, 184000), (0, 5999)], "s bigint, e bigint")
    got = [r.h for r in df.select(J.run_header("s", "e").alias("h")).collect()]
    assert got == ["Started: unknown", "Started: 1970-01-01 00:00:00 UTC (still running)",
                   "Started: 1970-01-01 00:00:00 UTC (1h2m)", "Started: 1970-01-01 00:00:00 UTC (3m4s)",
                   "Started: 1970-01-01 00:00:00 UTC (5s)"]


def test_resolve(spark, runs):
    jobs = spark.createDataFrame([(1, "job-a", [conf(v="/Volumes/logs/")], []), (2, "job-b", [conf(s="s3://x")], []),
                                  (3, "job-a", [conf(v="/V/other")], [])], JOBS)
    req = spark.createDataFrame([
        (1, "job-a", None, "prod"),                    # name, latest run
        (2, "https://h/jobs/1/runs/10", None, "dev"),  # URL with run
        (3, "https://h/#job/1", 10, "prod"),           # explicit run id wins
        (4, "nope", None, "prod"),
        (5, "job-b", None, "prod"),                    # s3 destination
        (6, "https://h/clusters/1", None, "prod"),
        (7, "job-a", 0, "prod"),                       # run id 0 means latest
    ], "request_id bigint, job_input string, run_id bigint, env string")
    got = {r.request_id: r for r in R.resolve_runs(req, jobs, runs).collect()}
    assert (got[1].job_id, got[1].run_id, got[1].base_path) == (1, 11, "/Volumes/logs/c-11")
    assert (got[2].run_id, got[2].job_name, got[2].env) == (10, "job-a", "dev")
    assert got[3].run_id == 10
    assert got[4].error == "no job is named nope"
    assert got[5].error.startswith("job 2: logs are delivered to S3")
    assert got[6].error.startswith("not a job URL")
    assert got[7].run_id == 11 and got[7].error is None


def test_resolve_all_clusters(spark):
    jobs = spark.createDataFrame([(1, "job-a", [conf(v="/V")], [])], JOBS)
    runs = spark.createDataFrame([run(20, 1, 10, 20, own="c-own", tasks=["c-own", "c-t1", "", "c-t2"]),
                                  run(21, 1, 5, 6, tasks=[])], RUNS_RAW)
    req = spark.createDataFrame([(1, "job-a", 20, "prod"), (2, "job-a", 21, "prod")],
                                "request_id bigint, job_input string, run_id bigint, env string")
    one = R.resolve_runs(req, jobs, runs).orderBy("request_id").collect()
    assert one[0].base_path == "/V/c-own" and one[1].error.startswith("run 21: no cluster is known")
    many = R.resolve_runs(req, jobs, runs, all_clusters=True).where("request_id = 1").collect()
    assert sorted(r.base_path for r in many) == ["/V/c-own", "/V/c-t1", "/V/c-t2"]
    err = R.resolve_runs(req, jobs, runs, all_clusters=True).where("request_id = 2").collect()
    assert len(err) == 1 and err[0].error.startswith("run 21: no cluster is known")
