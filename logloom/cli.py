"""Command line: the viewer's options over log trees, run as a Spark job.

    python -m logloom RUN_ROOT [RUN_ROOT ...] [--source S] [--stream S]
        [--level L] [--grep RE] [--since T] [--tail N] [--focus]
        [--include-log4j] [--include-stacktrace] [--format text|jsonl]
        [--output DIR] [--triage DIR] [--follow CHECKPOINT [--growing] [--available-now]]

    python -m logloom JOB_INPUT --jobs JOBS --runs RUNS [--run-id R] [--env E] ...

With ``--jobs``/``--runs`` (tables of job settings and runs, parquet or JSON
lines) the positional arguments are job names or workspace URLs, resolved
to run roots by ``resolve_runs``. Without ``--output`` the merged lines are
streamed to stdout one partition at a time (``toLocalIterator``); with it,
Spark writes ordered part files.
"""

from __future__ import annotations

import argparse
import sys


def _table(spark, path: str):
    return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def _resolve(spark, args) -> list[str]:
    from logloom.operators.runs import resolve_runs
    from logloom.schema import JOBS, RUNS_RAW

    reqs = spark.createDataFrame(
        [(i, x, int(args.run_id) if args.run_id else None, args.env) for i, x in enumerate(args.inputs)],
        "request_id bigint, job_input string, run_id bigint, env string",
    )
    jobs = spark.read.schema(JOBS).json(args.jobs) if args.jobs.endswith((".json", ".jsonl")) else _table(
        spark, args.jobs)
    runs = spark.read.schema(RUNS_RAW).json(args.runs) if args.runs.endswith((".json", ".jsonl")) else _table(
        spark, args.runs)
    resolved = resolve_runs(reqs, jobs, runs, all_clusters=args.all_clusters)
    roots = []
    # one row per input argument: a handful of rows by construction
    for r in resolved.orderBy("request_id").toLocalIterator():
        if r.error:
            print(f"Error: {r.error}", file=sys.stderr)
            continue
        print(f"Run: {r.cluster_id} | Job: {r.job_name} | Env: {r.env}", file=sys.stderr)
        roots.append(r.base_path)
    return roots


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="logloom", description="Merged, filtered driver and executor logs.")
    p.add_argument("inputs", nargs="+", help="run log roots, or job names / URLs with --jobs and --runs")
    p.add_argument("--jobs"), p.add_argument("--runs")
    p.add_argument("--run-id", "-r"), p.add_argument("--env", "-e", default="prod")
    p.add_argument("--all-clusters", action="store_true", help="read every cluster a run's tasks ran on")
    p.add_argument("--source", "-s", default="all"), p.add_argument("--stream", default="all")
    p.add_argument("--level", "-l"), p.add_argument("--grep", "-g"), p.add_argument("--since")
    p.add_argument("--tail", "-n", type=int), p.add_argument("--focus", action="store_true")
    p.add_argument("--include-log4j", action="store_true"), p.add_argument("--include-stacktrace", action="store_true")
    p.add_argument("--format", "-f", dest="fmt", default="text", choices=["text", "jsonl"])
    p.add_argument("--output", "-o", help="write ordered part files here instead of stdout")
    p.add_argument("--triage", help="write the triage tables (parquet) under this folder")
    p.add_argument("--follow", metavar="CHECKPOINT",
                   help="follow new log files (streaming) into --output, with this checkpoint folder")
    p.add_argument("--growing", action="store_true", help="with --follow: also lines appended to active files")
    p.add_argument("--available-now", action="store_true", help="with --follow: process what exists, then stop")
    p.add_argument("--master", default=None)
    args = p.parse_args(argv)

    from pyspark.sql import SparkSession

    from logloom.plans.query import query_logs, triage
    from logloom.session import configure, ensure_checkpoint_dir
    from logloom.sinks.output import render, write_entries
    from logloom.sources.scan import scan_logs

    b = SparkSession.builder.appName("logloom")
    if args.master:
        b = b.master(args.master)
    spark = configure(b.getOrCreate())
    ensure_checkpoint_dir(spark)

    roots = _resolve(spark, args) if args.jobs and args.runs else list(args.inputs)
    if not roots:
        print("nothing to read", file=sys.stderr)
        return 0
    if args.follow:
        from logloom.streaming.follow import follow_logs, follow_to

        if not args.output:
            p.error("--follow needs --output")
        stream = follow_logs(spark, roots, source=args.source, stream=args.stream, level=args.level, grep=args.grep,
                             focus=args.focus, since=args.since, include_log4j=args.include_log4j,
                             include_stacktrace=args.include_stacktrace,
                             growing=args.growing, state=f"{args.follow}/growing" if args.growing else None)
        follow_to(stream, args.output, args.follow, available_now=args.available_now).awaitTermination()
        return 0
    df = query_logs(spark, roots, source=args.source, stream=args.stream, level=args.level, grep=args.grep,
                    since=args.since, tail=args.tail, focus=args.focus, include_log4j=args.include_log4j,
                    include_stacktrace=args.include_stacktrace)
    if args.triage:
        for name, t in triage(scan_logs(spark, roots, include_log4j=args.include_log4j,
                                        include_stacktrace=args.include_stacktrace), materialize=True).items():
            t.write.mode("overwrite").parquet(f"{args.triage.rstrip('/')}/{name}")
    if args.output:
        write_entries(df, args.output, fmt=args.fmt, ordered=False)  # df is already in merged order
        return 0
    try:
        for row in df.select(render(df, args.fmt).alias("v")).toLocalIterator():
            sys.stdout.write(row.v + "\n")
    except BrokenPipeError:
        return 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
