"""Listing, classification and the scan of log trees."""

import os

import pytest
from pyspark.sql import functions as F

import logtree
from logloom.sources.files import classify_files, discover, run_summary
from logloom.sources.scan import scan_logs, skipped_files


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("logs"))
    return logtree.build(root)


def classify(spark, names, **kw):
    df = spark.createDataFrame([(n,) for n in names], "path string")
    return {r.path.rsplit("/", 1)[1]: r for r in classify_files(df, **kw).collect()}


def test_driver_names(spark):
    base = "/l/c/driver/"
    got = classify(spark, [base + n for n in ["stderr", "stdout", "stderr--2026-03-11--18-00", "stdout--2026-03-11--1830",
                                              "stderr.gz", "log4j-active.log", "stacktrace.log", "eventlog"]])
    assert set(got) == {"stderr", "stdout", "stderr--2026-03-11--18-00", "stdout--2026-03-11--1830"}
    r = got["stderr--2026-03-11--18-00"]
    assert (r.stream, r.is_compressed, r.is_active) == ("stderr", False, False)
    assert (r.file_timestamp.hour, r.file_timestamp.minute) == (18, 0)
    assert got["stdout--2026-03-11--1830"].file_timestamp.minute == 30
    assert got["stderr"].is_active and got["stderr"].file_timestamp is None


def test_opt_in_families(spark):
    base = "/l/c/driver/"
    names = ["log4j-active.log", "log4j-2026-03-11-17.log.gz", "stacktrace.log", "2026-03-11-17.stacktrace.log.gz"]
    assert classify(spark, [base + n for n in names]) == {}
    got = classify(spark, [base + n for n in names], include_log4j=True, include_stacktrace=True)
    assert got["log4j-2026-03-11-17.log.gz"].is_compressed and got["log4j-2026-03-11-17.log.gz"].file_timestamp.hour == 17
    assert got["log4j-active.log"].is_active and not got["log4j-active.log"].is_compressed
    assert got["2026-03-11-17.stacktrace.log.gz"].stream == "stacktrace"


def test_executor_names(spark):
    base = "/l/c/executor/app-20260311170849-0000/3/"
    got = classify(spark, [base + n for n in ["stderr", "stderr--2026-03-11--18.gz", "stdout--2026-03-11--18",
                                              "stderr.gz", "stdout--2026-13-01--05", "core.dump"]])
    assert set(got) == {"stderr", "stderr--2026-03-11--18.gz", "stdout--2026-03-11--18", "stderr.gz",
                        "stdout--2026-13-01--05"}
    gz = got["stderr--2026-03-11--18.gz"]
    assert (gz.source_type, gz.source_detail, gz.app_id, gz.is_compressed, gz.is_active) == (
        "executor", "3", "app-20260311170849-0000", True, False)
    assert gz.file_timestamp.hour == 18
    assert got["stderr.gz"].file_timestamp is None and not got["stderr.gz"].is_active  # kept, no time
    assert got["stdout--2026-13-01--05"].file_timestamp is None  # impossible date


def test_bad_app_dir_and_depth(spark):
    names = ["/l/c/executor/app-2026-0000/0/stderr", "/l/c/executor/app-20260311170849-0000/stderr",
             "/l/c/driver/sub/stderr", "/l/c/executor/app-20260311170849-0000/x/stderr"]
    got = classify(spark, names)
    assert list(got) == ["stderr"] and len(classify_files(
        spark.createDataFrame([(n,) for n in names], "path string")).collect()) == 1


def test_discover_and_summary(spark, tree):
    files = discover(spark, list(tree.values()))
    s = {r.run_key.rsplit("/", 1)[1]: r for r in run_summary(files).collect()}
    assert (s["c1"].has_driver, s["c1"].has_executor, s["c1"].executor_count) == (True, True, 4)
    assert s["c1"].app_id == logtree.APP
    assert (s["c2"].has_driver, s["c2"].has_executor, s["c2"].executor_count) == (True, False, 0)
    # 3 driver files (log4j/stacktrace not opted in) + 4 executors x 3 + 1 damaged gz + 1 rotated stdout
    assert s["c1"].n_files == 3 + 12 + 2
    zero = files.where(F.col("length") == 0).count()
    assert zero == 4  # empty stdout of each executor is a file


def test_scan_lines(spark, tree):
    e = scan_logs(spark, list(tree.values()))
    assert e.where(F.col("line") == "").count() == 0
    drv = [r.line for r in e.where(F.col("file_origin").endswith("/c1/driver/stderr")).orderBy("line_no").collect()]
    assert drv == [x for x in logtree.DRIVER_STDERR.splitlines() if x.strip()]
    bad = e.where(F.col("stream") == "stdout").where(F.col("source_detail") == "1").first()
    assert "��" in bad.line and bad.level == 30
    # damaged gzip: no line of it, its neighbours intact
    assert e.where(F.col("file_origin").endswith("--17.gz")).count() == 0
    assert e.where(F.col("file_origin").endswith("/2/stderr--2026-03-11--18.gz")).count() == 4


def test_scan_filters_prune(spark, tree):
    e = scan_logs(spark, list(tree.values()), source="executor:10", stream="stderr")
    assert {r.source_detail for r in e.collect()} == {"10"}
    e = scan_logs(spark, list(tree.values()), source="driver", include_log4j=True)
    assert {r.stream for r in e.collect()} == {"stderr", "stdout", "log4j"}


def test_skipped_report(spark, tree):
    files = discover(spark, list(tree.values()))
    skipped = [r.path for r in skipped_files(spark, files, list(tree.values())).collect()]
    assert len(skipped) == 1 and skipped[0].endswith("/2/stderr--2026-03-11--17.gz")


def test_query_logs_end_to_end(spark, tree):
    from logloom.plans.query import query_logs

    out = query_logs(spark, [tree["c1"]], level="ERROR", tail=3).collect()
    assert [r.line for r in out] == ["26/03/11 19:11:00 ERROR Exec2: step 1", "26/03/11 19:11:00 ERROR Exec10: step 1",
                                     "26/03/11 21:01:15 ERROR TransportChannelHandler: peer 10.9.8.7 "
                                     "sent nothing for two minutes"]
    hidden = query_logs(spark, [tree["c2"]], level="WARN").count()
    assert hidden == 0


def test_follow_available_now(spark, tree, tmp_path):
    from logloom.streaming.follow import follow_logs, follow_to

    df = follow_logs(spark, list(tree.values()), level="ERROR")
    q = follow_to(df, str(tmp_path / "out"), str(tmp_path / "ckpt"), available_now=True)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 10  # 4 executors x 2 files + one driver error per run; damaged gz dropped
    assert os.path.isdir(str(tmp_path / "ckpt"))


def test_missing_root_and_empty(spark, tree, tmp_path):
    from logloom.plans.query import query_logs

    missing = str(tmp_path / "no-such-run")
    assert scan_logs(spark, [missing]).count() == 0
    assert query_logs(spark, [missing, tree["c2"]], level="ERROR").count() == 1
    assert discover(spark, [missing]).count() == 0


def test_lenient_gzip_mode(spark, tree):
    strict = scan_logs(spark, [tree["c1"]], source="executor:2")
    lenient = scan_logs(spark, [tree["c1"]], source="executor:2", strict_corrupt=False)
    # same lines from the intact files, in the same order
    ok = F.col("file_origin").endswith("--18.gz")
    assert [r.line for r in strict.where(ok).orderBy("line_no").collect()] == \
        [r.line for r in lenient.where(ok).orderBy("line_no").collect()]
    assert lenient.count() >= strict.count()


def test_honor_offset(spark, lines):
    from logloom.functions.parse import parse_timestamp

    df = lines("[2026-03-11T21:01:07.016+0200] x")
    a = df.select(F.date_format(parse_timestamp("line"), "HH:mm").alias("t")).first().t
    b = df.select(F.date_format(parse_timestamp("line", honor_offset=True), "HH:mm").alias("t")).first().t
    assert (a, b) == ("21:01", "19:01")


def test_split_files_merge_like_heap(spark, tmp_path):
    """Plain files cut into many splits: line order and the two-level merge
    over real splits equal a heap merge of the files read in Python."""
    import heapq
    import random
    import datetime as dt

    from logloom.plans.query import query_logs
    from logloom.functions.parse import parse_timestamp  # noqa: F401  (same parser as the scan)

    rnd = random.Random(3)
    root = str(tmp_path / "run")
    names = {"driver/stderr": 0, f"executor/{logtree.APP}/0/stderr": 1, f"executor/{logtree.APP}/1/stderr": 2}
    contents = {}
    for rel in names:
        lines = []
        for i in range(1500 if rel == "driver/stderr" else 300):
            if rnd.random() < 0.25:
                lines.append(f"\tat frame {rel} {i}")
            else:
                m = rnd.randint(0, 600)
                lines.append(f"26/03/11 {10 + m // 60:02d}:{m % 60:02d}:00 INFO {rel} {i}")
        contents[rel] = lines
        logtree._w(f"{root}/{rel}", "\n".join(lines) + "\n")

    def key(line):
        import re
        m = re.search(r"(\d{2})/(\d{2})/(\d{2}) (\d{2}):(\d{2}):(\d{2})", line)
        return None if not m else dt.datetime(2026, 3, 11, int(m.group(4)), int(m.group(5)))

    its = []
    for rel, idx in names.items():
        ks = [key(x) for x in contents[rel]]
        first = next((k for k in ks if k), dt.datetime.min)
        its.append([((k or first, idx, i), x) for i, (k, x) in enumerate(zip(ks, contents[rel]))])
    expected = [x for _, x in heapq.merge(*its, key=lambda p: p[0])]

    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        e = scan_logs(spark, [root])
        assert e.select("file_origin", "block_start").distinct().count() > 10  # really split
        got = [r.line for r in query_logs(spark, [root]).select("line").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == expected


def test_cli_text_and_jsonl(spark, tree, tmp_path, capsys):
    import json

    from logloom.cli import main

    assert main([tree["c1"], tree["c2"], "--level", "ERROR", "--tail", "2", "--source", "driver"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 2 and all(x.startswith("[driver:stderr 2026-03-1") for x in out)
    dest = str(tmp_path / "cli-out")
    assert main([tree["c1"], "--format", "jsonl", "--focus", "--output", dest, "--triage", str(tmp_path / "t")]) == 0
    rows = [json.loads(r.value) for r in spark.read.text(dest).collect()]
    assert rows and all(set(r) == {"source_type", "source_detail", "stream", "timestamp", "level", "file", "line"}
                        for r in rows)
    assert spark.read.parquet(str(tmp_path / "t" / "root_cause_counts")).count() >= 1


def test_odd_names_and_exact_depth(spark, tmp_path):
    """Selectors compare whole decoded parts; glob characters are ordinary;
    a driver folder anywhere but below the root is not the run's."""
    import pathlib

    root = tmp_path / "jobs {a}[b]" / "c*1"

    def put(rel, text):
        p = pathlib.Path(root, rel)
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    app = logtree.APP
    put("driver/stderr", "of the driver\n")
    for n in ("ex 7", "{8}", "a+b%20"):
        put(f"executor/{app}/{n}/stderr", f"of {n}\n")
    put("eventlog/driver/stderr", "nested 1\n")
    put(f"executor/{app}/0/driver/stderr", "nested 2\n")
    roots = [str(root)]

    def lines_of(**kw):
        return sorted(r.line for r in scan_logs(spark, roots, **kw).collect())

    assert lines_of() == ["of a+b%20", "of ex 7", "of the driver", "of {8}"]
    assert lines_of(source="executor:ex 7") == ["of ex 7"]
    assert lines_of(source="executor:{8}") == ["of {8}"]
    assert lines_of(source="executors") == []
    assert {r.run_key for r in discover(spark, roots).collect()} == {str(root)}
    assert discover(spark, roots).count() == 4


def test_plain_file_gone_after_listing(spark, tmp_path):
    from logloom.plans.query import query_entries, query_logs_report

    d = tmp_path / "run" / "driver"
    d.mkdir(parents=True)
    (d / "stderr").write_text("26/03/11 10:00:00 ERROR stays\n")
    (d / "stdout").write_text("26/03/11 10:00:01 ERROR goes\n")
    listed = scan_logs(spark, str(tmp_path / "run"))
    entries, skipped = query_logs_report(spark, str(tmp_path / "run"), level="ERROR")
    (d / "stdout").unlink()
    # the merge has read the files when it was called; a scan listed before it is gone leaves it out
    assert [r.line for r in entries.collect()] == ["26/03/11 10:00:00 ERROR stays", "26/03/11 10:00:01 ERROR goes"]
    assert [r.line for r in query_entries(listed, level="ERROR").collect()] == ["26/03/11 10:00:00 ERROR stays"]
    assert skipped.collect() == []


def test_report_covers_the_query_and_any_size(spark, tree):
    from logloom.plans.query import query_logs_report

    entries, skipped = query_logs_report(spark, list(tree.values()), source="executor", level="ERROR")
    assert entries.count() == 8
    assert [(r.source_detail, r.stream, r.path.rsplit("/", 1)[1]) for r in skipped.collect()] == [
        ("2", "stderr", "stderr--2026-03-11--17.gz")]
    assert query_logs_report(spark, tree["c1"], source="driver")[1].count() == 0


def test_triage_materialized_matches_lazy(spark, tree):
    from logloom.plans.query import triage

    lazy = triage(scan_logs(spark, list(tree.values())))
    mat = triage(scan_logs(spark, list(tree.values())), materialize=True)
    for name in lazy:
        a = sorted(tuple(r) for r in lazy[name].collect())
        b = sorted(tuple(r) for r in mat[name].collect())
        assert a == b, name
    assert sorted(lazy) == ["error_timeline", "errors_by_source", "errors_per_executor", "executor_spread",
                            "first_error", "root_cause_counts", "suggested_actions"]


def test_cli_follow(spark, tree, tmp_path):
    from logloom.cli import main

    out, ck = str(tmp_path / "follow-out"), str(tmp_path / "follow-ck")
    assert main([tree["c1"], "--level", "ERROR", "--follow", ck, "--available-now", "--output", out]) == 0
    assert spark.read.parquet(out).count() == 9  # 4 executors x 2 files + the driver error


def test_duplicate_and_nested_roots(spark, tree):
    from logloom.sources.scan import existing_roots

    base = scan_logs(spark, [tree["c1"]]).count()
    assert scan_logs(spark, [tree["c1"], tree["c1"] + "/"]).count() == base
    parent = tree["c1"].rsplit("/", 1)[0]
    assert existing_roots(spark, [tree["c1"], parent, tree["c2"]]) == [parent]
    assert existing_roots(spark, [tree["c1"], tree["c2"], parent + "/nope"]) == sorted([tree["c1"], tree["c2"]])


def test_follow_since(spark, tree, tmp_path):
    from logloom.streaming.follow import follow_logs, follow_to

    q = follow_to(follow_logs(spark, [tree["c1"]], since="2026-03-11T19:00:00"), str(tmp_path / "o"),
                  str(tmp_path / "c"), available_now=True)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "o"))
    assert got.count() > 0 and got.where("timestamp < '2026-03-11 19:00:00'").count() == 0


def test_cli_resolves_job_name(spark, tree, tmp_path, capsys):
    from logloom.cli import main
    from logloom.schema import JOBS, RUNS_RAW

    dest = tree["c1"].rsplit("/", 1)[0]  # <root>/job ; cluster dir c1
    conf = {"new_cluster": {"cluster_log_conf": {"volumes": {"destination": dest + "/"}, "dbfs": None, "s3": None}}}
    jobs = spark.createDataFrame([(7, "nightly", [conf], [])], JOBS)
    runs = spark.createDataFrame([(70, 7, 1000, 2000, {"life_cycle_state": "TERMINATED"}, {"cluster_id": "c1"}, []),
                                  (71, 7, 500, 600, {"life_cycle_state": "TERMINATED"}, {"cluster_id": "c2"}, [])],
                                 RUNS_RAW)
    jp, rp = str(tmp_path / "jobs.json"), str(tmp_path / "runs.json")
    jobs.write.json(jp)
    runs.write.json(rp)
    assert main(["nightly", "--jobs", jp, "--runs", rp, "--level", "ERROR", "--tail", "1"]) == 0
    out = capsys.readouterr()
    assert "Run: c1 | Job: nightly" in out.err  # latest run (start 1000) is on cluster c1
    assert out.out.splitlines() == ["[driver:stderr 2026-03-11T21:01:15] 26/03/11 21:01:15 ERROR "
                                    "TransportChannelHandler: peer 10.9.8.7 sent nothing for two minutes"]
    assert main(["nightly", "--jobs", jp, "--runs", rp, "--run-id", "71", "--level", "ERROR"]) == 0
    assert capsys.readouterr().out.splitlines() == ["[driver:stderr 2026-03-12T01:00:00] 26/03/12 01:00:00 ERROR Main: failed"]


def test_gzip_by_line_keeps_intact_files(spark, tree):
    whole = scan_logs(spark, [tree["c1"]], source="executor:2")
    by_line = scan_logs(spark, [tree["c1"]], source="executor:2", strict_corrupt=False)
    ok = F.col("file_origin").endswith("--18.gz")
    assert [r.line for r in whole.where(ok).orderBy("line_no").collect()] == \
        [r.line for r in by_line.where(ok).orderBy("line_no").collect()]
    assert by_line.count() >= whole.count()


def test_files_without_a_possible_hit_are_not_opened(spark, tmp_path):
    import gzip

    from logloom.plans.query import query_logs
    from logloom.sources.stats import required_texts, write_file_stats

    root = tmp_path / "run"
    early = "26/03/11 10:00:00 INFO needle one\n"
    files = {"driver/stderr--2026-03-11--10-00": early, "driver/stderr": "26/03/11 12:00:00 INFO needle two\n",
             "driver/stdout": "26/03/11 12:30:00 INFO hay\n", "driver/stdout--2026-03-11--11-00": "needle, no stamp\nab\n",
             "executor/app-20260311170849-0000/0/stderr--2026-03-11--10.gz": early}
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
    stats = write_file_stats(spark, str(root), str(tmp_path / "stats"))
    assert stats.count() == 5
    asked = [{"since": "2026-03-11T11:00:00"}, {"grep": "needle"}, {"grep": "nee.*two|hay"}, {"grep": "n[e]+dle"}, {"grep": "ab"},
             {"grep": "nothing like it"}, {"since": "2026-03-11T11:00:00", "grep": "needle"}, {}]
    lines = lambda df: sorted(r.line for r in df.select("line").collect())
    want = [lines(query_logs(spark, str(root), **a)) for a in asked]
    assert [lines(query_logs(spark, str(root), stats=stats, **a)) for a in asked] == want
    assert required_texts("a.*b|c d") == [["a", "b"], ["c d"]] and required_texts("a?b") is None

    # other content of the same size: seen only where a file is opened
    old = root / "driver/stdout"
    old.write_text("26/03/11 12:30:00 INFO ned\n")
    assert lines(query_logs(spark, str(root), stats=stats, grep="INFO ned")) == []
    old.write_text("26/03/11 12:30:00 INFO ned, longer\n")  # changed: read again
    assert lines(query_logs(spark, str(root), stats=stats, grep="INFO ned")) == ["26/03/11 12:30:00 INFO ned, longer"]


def test_listing_in_tasks(spark, tmp_path, monkeypatch):
    """Exact depths, zero-length files, missing and repeated roots; the same
    from Spark's file index, which also lists other depths."""
    from logloom.sources import files

    app = "app-20260311170849-0000"
    there = ["r1/driver/stderr", "r1/driver/stdout--2026-03-11--18-00", f"r1/executor/{app}/0/stderr", f"r1/executor/{app}/x y/stdout",
             "r 2+%20/driver/stdout"]
    other = ["r1/driver/deep/stderr", f"r1/executor/{app}/stderr", "r1/executor/app-1/0/stderr", "r1/eventlog/x", "r1/stderr"]
    for i, name in enumerate(there + other):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * i)
    roots = [str(tmp_path / "r1"), f"{tmp_path}/r1/", str(tmp_path / "r 2+%20"), str(tmp_path / "none")]
    want = {str(tmp_path / name): i for i, name in enumerate(there)}
    assert {r.path: r.length for r in files.list_files(spark, roots).collect()} == want
    found = {r.path for r in files.discover(spark, roots).collect()}
    monkeypatch.setattr(files, "readable", lambda r: False)
    assert {r.path: r.length for r in files.list_files(spark, roots).collect()}.items() >= want.items()
    assert {r.path for r in files.discover(spark, roots).collect()} == found == set(want)
    assert files.list_files(spark, [str(tmp_path / "none")]).count() == 0


def test_report_of_blank_and_empty_files(spark, tmp_path):
    """Files that were read but hold no line are not reported; all are read once."""
    import gzip

    from logloom.plans.query import query_logs_report

    d = tmp_path / "run/executor/app-20260311170849-0000/0"
    d.mkdir(parents=True)
    whole = gzip.compress(b"26/03/11 10:00:00 ERROR a\n")
    for name, data in {"stderr": b"\n  \n", "stderr--2026-03-11--10.gz": gzip.compress(b""), "stderr--2026-03-11--11.gz": whole,
                       "stdout--2026-03-11--11.gz": whole[:-4], "stdout": b""}.items():
        (d / name).write_bytes(data)
    entries, skipped = query_logs_report(spark, str(tmp_path / "run"))
    for f in d.iterdir():  # both results are of the one read
        f.write_bytes(b"")
    assert [r.line for r in entries.collect()] == ["26/03/11 10:00:00 ERROR a"]
    assert [r.path.rsplit("/", 1)[1] for r in skipped.collect()] == ["stdout--2026-03-11--11.gz"]
