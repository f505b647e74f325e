"""DuckDB SQL for the file, job and run queries.

Destinations and cluster ids are stated directly from the key rules that
build the nested job and run records, so the oracle checks the nested-array
logic of the Spark side rather than repeating it.
"""

from __future__ import annotations

from logloom import rules
from logloom.plans.oracle import _q, iso
from logloom.sources import adapter as A


def _pick(idx: str, names: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {idx} = {i} THEN {n}" for i, n in enumerate(names)) + " END"


def listing_cte() -> str:
    ymd, year = "strftime(o_orderdate, '%Y-%m-%d')", "strftime(o_orderdate, '%Y')"
    hh, mm = "lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0')", "lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0')"
    drv = ["'stderr'", "'stdout'", f"'stderr--' || {ymd} || '--' || {hh} || '-' || {mm}",
           f"'stdout--' || {ymd} || '--' || {hh} || {mm}", "'log4j-active.log'",
           f"'log4j-' || {ymd} || '-' || {hh} || '.log.gz'", "'stacktrace.log'",
           f"{ymd} || '-' || {hh} || '.stacktrace.log.gz'", "'stderr.gz'",
           f"'stderr--' || {year} || '-02-30--10-00'", f"'stdout--' || {ymd} || '--24-' || {mm}", "'notes.txt'"]
    exe = ["'stderr'", "'stdout'", f"'stderr--' || {ymd} || '--' || {hh}",
           f"'stdout--' || {ymd} || '--' || {hh} || '.gz'", "'stderr.gz'",
           f"'stderr--' || {ymd} || '--' || {hh} || '.gz'", f"'stdout--' || {year} || '-13-01--05'", "'core.dump'"]
    root = f"'{A.LOG_ROOT}' || CAST(o_custkey % 50 AS VARCHAR)"
    app = ("CASE WHEN o_orderkey % 17 = 0 THEN 'app-bad' ELSE 'app-' || strftime(o_orderdate, '%Y%m%d') || "
           "'000000-' || lpad(CAST(o_custkey % 3 AS VARCHAR), 4, '0') END")
    execnum = ("CASE WHEN o_orderkey % 31 = 0 THEN 'x' || CAST(o_orderkey % 5 AS VARCHAR) "
               "ELSE CAST(o_orderkey % 13 AS VARCHAR) END")
    v = "(o_orderkey // 3)"
    path = (f"CASE WHEN o_orderkey % 23 = 0 THEN {root} || '/eventlog/app/eventlog' "
            f"WHEN o_orderkey % 29 = 0 THEN {root} || '/init_scripts/init.sh' "
            f"WHEN o_orderkey % 3 = 0 THEN {root} || '/driver/' || {_pick(f'{v} % 12', drv)} "
            f"ELSE {root} || '/executor/' || {app} || '/' || {execnum} || '/' || {_pick(f'{v} % 8', exe)} END")
    return f"listing AS (SELECT DISTINCT {path} AS path FROM orders)"


_DRV = r"^(.*)/driver/([^/]+)$"
_EXE = r"^(.*)/executor/([^/]+)/([^/]+)/([^/]+)$"


def files_cte(log4j: bool, stacktrace: bool) -> str:
    def g(col: str, pat: str, i: int) -> str:
        return f"regexp_extract({col}, {_q(pat)}, {i})"

    def ts(col: str, pat: str, y: int, mo: int, d: int, h: int, mi: int | None) -> str:
        minute = g(col, pat, mi) if mi else "'00'"
        return (f"try_strptime({g(col, pat, y)} || '-' || {g(col, pat, mo)} || '-' || {g(col, pat, d)} || ' ' || "
                f"{g(col, pat, h)} || ':' || {minute}, '%Y-%m-%d %H:%M')")

    def m(col: str, pat: str) -> str:
        return f"regexp_matches({col}, {_q(pat)})"

    # driver: (condition, stream, compressed, active, ts)
    drv = []
    for stream, pat in (("stderr", rules.DRIVER_STDERR), ("stdout", rules.DRIVER_STDOUT)):
        rot = f"{g('dname', pat, 1)} <> ''"
        drv.append((m("dname", pat), stream, "false", f"NOT ({rot})",
                    f"CASE WHEN {rot} THEN {ts('dname', pat, 2, 3, 4, 5, 6)} END"))
    opt = []
    if log4j:
        opt.append(("log4j", rules.LOG4J_ACTIVE, rules.LOG4J_ROTATED))
    if stacktrace:
        opt.append(("stacktrace", rules.STACKTRACE_ACTIVE, rules.STACKTRACE_ROTATED))
    for stream, act, rot_pat in opt:
        drv.append((m("dname", act), stream, "false", "true", "NULL"))
        drv.append((m("dname", rot_pat), stream, "true", "false", ts("dname", rot_pat, 1, 2, 3, 4, None)))
    exe = []
    for stream, pat in (("stderr", rules.EXECUTOR_STDERR), ("stdout", rules.EXECUTOR_STDOUT)):
        rot = f"{g('ename', pat, 1)} <> ''"
        gz = f"{g('ename', pat, 6)} = '.gz'"
        exe.append((m("ename", pat), stream, gz, f"NOT ({rot}) AND NOT ({gz})",
                    f"CASE WHEN {rot} THEN {ts('ename', pat, 2, 3, 4, 5, None)} END"))

    def case(rows, idx):
        return "CASE " + " ".join(f"WHEN {r[0]} THEN {r[idx]}" for r in rows) + " END"

    stream_d = "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[1]}'" for r in drv) + " END"
    stream_e = "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[1]}'" for r in exe) + " END"
    return f"""parts AS (
  SELECT path,
    regexp_matches(path, {_q(_DRV)}) AS is_drv,
    regexp_extract(path, {_q(_DRV)}, 2) AS dname,
    regexp_matches(path, {_q(_EXE)})
      AND regexp_matches(regexp_extract(path, {_q(_EXE)}, 2), {_q(rules.APP_DIR)}) AS is_exe,
    regexp_extract(path, {_q(_EXE)}, 4) AS ename,
    regexp_extract(path, {_q(_EXE)}, 2) AS app,
    regexp_extract(path, {_q(_EXE)}, 3) AS edir,
    CASE WHEN regexp_matches(path, {_q(_DRV)}) THEN regexp_extract(path, {_q(_DRV)}, 1)
         ELSE regexp_extract(path, {_q(_EXE)}, 1) END AS root
  FROM listing
),
cls AS (
  SELECT path, root AS run_key,
    CASE WHEN is_drv THEN 'driver' ELSE 'executor' END AS source_type,
    CASE WHEN is_exe THEN app END AS app_id,
    CASE WHEN is_drv THEN '' ELSE edir END AS source_detail,
    CASE WHEN is_drv THEN {stream_d} WHEN is_exe THEN {stream_e} END AS stream,
    CASE WHEN is_drv THEN {case(drv, 2)} WHEN is_exe THEN {case(exe, 2)} END AS is_compressed,
    CASE WHEN is_drv THEN {case(drv, 3)} WHEN is_exe THEN {case(exe, 3)} END AS is_active,
    CASE WHEN is_drv THEN {case(drv, 4)} WHEN is_exe THEN {case(exe, 4)} END AS file_ts
  FROM parts
),
files AS (SELECT * FROM cls WHERE stream IS NOT NULL)"""


def _runs_cte() -> str:
    k = "o_orderkey"
    cid = f"'0101-' || lpad(CAST({k} AS VARCHAR), 6, '0')"
    return f"""runs AS (
  SELECT {k} AS run_id, o_custkey AS job_id,
    epoch_ms(o_orderdate) + ({k} % 86400) * 1000 AS start_time,
    CASE WHEN o_orderstatus = 'O' THEN NULL
         ELSE epoch_ms(o_orderdate) + ({k} % 86400) * 1000 + ({k} * 7919 % 20000) * 1000 + {k} % 1000 END AS end_time,
    CASE o_orderstatus WHEN 'F' THEN 'TERMINATED' WHEN 'O' THEN 'RUNNING' ELSE 'PENDING' END AS state,
    CASE WHEN {k} % 10 < 7 THEN {cid} || '-ci' WHEN {k} % 10 IN (7, 8) THEN {cid} || '-t2' END AS cluster_id
  FROM orders
),
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_time DESC, run_id DESC) AS rn
                 FROM runs) WHERE rn = 1
)"""


def _jobs_cte() -> str:
    c, n = "c_custkey", "c_nationkey"
    dest = (f"CASE WHEN {c} % 5 = 2 THEN rtrim('{A.VOLUME_ROOT}' || lower(c_mktsegment) || '/', '/') "
            f"WHEN {c} % 5 = 3 THEN '{A.DBFS_ROOT}' || CAST({c} AS VARCHAR) "
            f"WHEN {c} % 5 = 4 THEN rtrim('{A.S3_ROOT}' || CAST({c} AS VARCHAR) || '//', '/') "
            f"WHEN {n} % 4 = 0 THEN '{A.NATION_VOLUME_ROOT}' || CAST({n} AS VARCHAR) "
            f"WHEN {n} % 4 = 1 THEN rtrim('{A.NATION_DBFS_ROOT}' || CAST({n} AS VARCHAR) || '/', '/') "
            f"WHEN {c} % 2 = 0 THEN '{A.SHARED_VOLUME_ROOT}' || CAST({c} % 10 AS VARCHAR) END")
    kind = (f"CASE WHEN {c} % 5 = 2 THEN 'volumes' WHEN {c} % 5 = 3 THEN 'dbfs' WHEN {c} % 5 = 4 THEN 's3' "
            f"WHEN {n} % 4 = 0 THEN 'volumes' WHEN {n} % 4 = 1 THEN 'dbfs' WHEN {c} % 2 = 0 THEN 'volumes' END")
    return f"""jobs AS (
  SELECT {c} AS job_id, c_name AS name, {dest} AS destination, {kind} AS kind FROM customer
)"""


def _dest_error(jid: str) -> str:
    return (f"CASE WHEN kind IS NULL THEN 'job ' || CAST({jid} AS VARCHAR) || ': log delivery is not set up' "
            f"WHEN kind = 's3' THEN 'job ' || CAST({jid} AS VARCHAR) || ': logs are delivered to S3, which is not read (' || "
            "destination || ')' END")


def _url_parse(col: str) -> tuple[str, str, str]:
    pats = rules.URL_PATTERNS
    job = "CASE " + " ".join(f"WHEN regexp_matches({col}, {_q(p)}) THEN TRY_CAST(regexp_extract({col}, {_q(p)}, 1) "
                             "AS BIGINT)" for p in pats) + " END"
    run = "CASE " + " ".join(
        f"WHEN regexp_matches({col}, {_q(p)}) THEN "
        + (f"TRY_CAST(regexp_extract({col}, {_q(p)}, 2) AS BIGINT)" if p.count("(") == 2 else "NULL")
        for p in pats) + " END"
    is_url = "(" + " OR ".join(f"starts_with({col}, {_q(x)})" for x in rules.URL_PREFIXES) + ")"
    return is_url, job, run


def _requests_cte() -> str:
    k, c = "o_orderkey", "o_custkey"
    name = f"'Customer#' || lpad(CAST({c} AS VARCHAR), 9, '0')"
    inp = (f"CASE WHEN {k} % 5 = 1 THEN '{A.HOST}/jobs/' || CAST({c} AS VARCHAR) || '/runs/' || CAST({k} AS VARCHAR) "
           f"WHEN {k} % 5 = 2 THEN '{A.HOST}/#job/' || CAST({c} AS VARCHAR) "
           f"WHEN {k} % 5 = 4 THEN '{A.HOST}/jobs/' || CAST({c} + 100000 AS VARCHAR) ELSE {name} END")
    env = f"CASE {k} % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' ELSE 'ondemand' END"
    return f"""requests AS (
  SELECT {k} AS request_id, {inp} AS job_input, CASE WHEN {k} % 5 = 3 THEN {k} END AS run_id, {env} AS env
  FROM orders
)"""


def _header(s: str, e: str) -> str:
    secs = f"(({e} - {s}) // 1000)"
    h, mi, se = f"({secs} // 3600)", f"(({secs} // 60) % 60)", f"({secs} % 60)"
    dur = (f"CASE WHEN {h} <> 0 THEN CAST({h} AS VARCHAR) || 'h' || CAST({mi} AS VARCHAR) || 'm' "
           f"WHEN {mi} <> 0 THEN CAST({mi} AS VARCHAR) || 'm' || CAST({se} AS VARCHAR) || 's' "
           f"ELSE CAST({se} AS VARCHAR) || 's' END")
    start = f"strftime(epoch_ms({s}), '%Y-%m-%d %H:%M:%S') || ' UTC'"
    return (f"CASE WHEN {s} IS NULL THEN 'Started: unknown' WHEN {e} IS NULL THEN 'Started: ' || {start} || "
            f"' (still running)' ELSE 'Started: ' || {start} || ' (' || {dur} || ')' END")


def run_oracles() -> dict[str, str]:
    L = listing_cte()
    is_url, job, run = _url_parse("url")
    k, c = "o_orderkey", "o_custkey"
    k6 = f"{k} % 6"
    h = A.HOST
    url = (f"CASE WHEN {k6} = 0 THEN '{h}/jobs/' || CAST({c} AS VARCHAR) || '/runs/' || CAST({k} AS VARCHAR) "
           f"WHEN {k6} = 1 THEN '{h}/jobs/' || CAST({c} AS VARCHAR) "
           f"WHEN {k6} = 2 THEN '{h}/?o=1#job/' || CAST({c} AS VARCHAR) || '/run/' || CAST({k} AS VARCHAR) "
           f"WHEN {k6} = 3 THEN '{h.replace('https', 'http')}/#job/' || CAST({c} AS VARCHAR) "
           f"WHEN {k6} = 4 THEN '{h}/clusters/' || CAST({k} AS VARCHAR) "
           f"ELSE 'Customer#' || lpad(CAST({c} AS VARCHAR), 9, '0') END")
    ri_url, ri_job, ri_run = _url_parse("job_input")
    return {
        "classify_files": f"WITH {L}, {files_cte(True, True)} SELECT path, run_key, source_type, app_id, "
        f"source_detail, stream, is_compressed, is_active, CASE WHEN file_ts IS NOT NULL THEN {iso('file_ts')} END "
        "AS file_ts FROM files",
        "file_order": f"WITH {L}, {files_cte(False, False)} SELECT run_key, path, CAST(row_number() OVER ("
        "PARTITION BY run_key ORDER BY source_type = 'executor', CASE WHEN source_type = 'executor' AND "
        "regexp_matches(source_detail, '^[0-9]{1,18}$') THEN CAST(source_detail AS BIGINT) ELSE 0 END, "
        "coalesce(app_id, ''), source_detail, stream, coalesce(file_ts, TIMESTAMP '9999-12-31 23:59:59'), path) - 1 "
        "AS INTEGER) AS file_idx FROM files",
        "run_summary": f"WITH {L}, {files_cte(False, False)} SELECT run_key, bool_or(source_type = 'driver') AS "
        "has_driver, bool_or(source_type = 'executor') AS has_executor, CAST(count(DISTINCT CASE WHEN source_type "
        "= 'executor' THEN app_id || '/' || source_detail END) AS INTEGER) AS executor_count, max(app_id) AS "
        "app_id, count(*) AS n_files FROM files GROUP BY run_key",
        "file_count": f"WITH {L}, {files_cte(True, True)} SELECT run_key, source_type, stream, count(*) AS n_files "
        "FROM files GROUP BY run_key, source_type, stream",
        "parse_job_url": f"SELECT url_id, url, {is_url} AS is_url, {job} AS job_id, {run} AS run_id FROM "
        f"(SELECT {k} AS url_id, {url} AS url FROM orders)",
        "job_by_name": f"WITH {_requests_cte()}, {_jobs_cte()} SELECT r.request_id, r.job_input, b.job_id FROM "
        f"requests r LEFT JOIN (SELECT name, min(job_id) AS job_id FROM jobs GROUP BY name) b ON r.job_input = "
        f"b.name WHERE NOT {ri_url}",
        "run_lookup": f"WITH {_requests_cte()}, {_runs_cte()} SELECT q.request_id, q.run_id, r.run_id IS NOT NULL "
        "AS found, r.start_time FROM requests q LEFT JOIN runs r ON q.run_id = r.run_id WHERE q.run_id IS NOT NULL",
        "latest_run": f"WITH {_runs_cte()} SELECT job_id, run_id, start_time FROM latest",
        "run_header": f"WITH {_runs_cte()} SELECT run_id, {_header('start_time', 'end_time')} AS header FROM runs",
        "log_destination": f"WITH {_jobs_cte()} SELECT job_id, destination, kind, {_dest_error('job_id')} AS error "
        "FROM jobs",
        "cluster_id": f"WITH {_runs_cte()} SELECT run_id, cluster_id, CASE WHEN cluster_id IS NULL THEN 'run ' || "
        "CAST(run_id AS VARCHAR) || ': no cluster is known (state ' || state || ')' END AS error FROM runs",
        "resolve_runs": f"""WITH {_requests_cte()}, {_jobs_cte()}, {_runs_cte()},
p AS (SELECT *, {ri_url} AS is_url, {ri_job} AS url_job, {ri_run} AS url_run FROM requests),
byname AS (SELECT name, min(job_id) AS job_id FROM jobs GROUP BY name),
r1 AS (SELECT p.*, CASE WHEN p.is_url THEN p.url_job ELSE b.job_id END AS jid
       FROM p LEFT JOIN byname b ON NOT p.is_url AND p.job_input = b.name),
r2 AS (SELECT r1.*, j.job_id AS jj, j.name AS jname, j.destination, j.kind,
              coalesce(r1.run_id, CASE WHEN r1.is_url THEN r1.url_run END) AS want
       FROM r1 LEFT JOIN jobs j ON j.job_id = r1.jid),
r3 AS (SELECT *, (want IS NOT NULL AND want <> 0) AS has_run FROM r2),
r4 AS (SELECT r3.*, ru.run_id AS ru_id, la.run_id AS la_id,
         CASE WHEN has_run THEN ru.run_id ELSE la.run_id END AS rid,
         CASE WHEN has_run THEN ru.cluster_id ELSE la.cluster_id END AS cid,
         CASE WHEN has_run THEN ru.state ELSE la.state END AS rstate,
         CASE WHEN has_run THEN ru.start_time ELSE la.start_time END AS rstart,
         CASE WHEN has_run THEN ru.end_time ELSE la.end_time END AS rend
       FROM r3 LEFT JOIN runs ru ON r3.has_run AND ru.run_id = r3.want
               LEFT JOIN latest la ON NOT r3.has_run AND la.job_id = r3.jid),
r5 AS (SELECT *, coalesce(
         CASE WHEN is_url AND url_job IS NULL THEN 'not a job URL: ' || job_input END,
         CASE WHEN NOT is_url AND jid IS NULL THEN 'no job is named ' || job_input END,
         CASE WHEN jj IS NULL THEN 'no job has id ' || CAST(jid AS VARCHAR) END,
         {_dest_error('jid')},
         CASE WHEN has_run AND ru_id IS NULL THEN 'no run has id ' || CAST(want AS VARCHAR) END,
         CASE WHEN NOT has_run AND la_id IS NULL THEN 'never run: job ' || CAST(jid AS VARCHAR) END,
         CASE WHEN cid IS NULL THEN 'run ' || CAST(rid AS VARCHAR) || ': no cluster is known (state ' ||
              rstate || ')' END) AS error FROM r4)
SELECT request_id,
  CASE WHEN error IS NULL THEN jid END AS job_id,
  CASE WHEN error IS NULL THEN CASE WHEN is_url THEN jname ELSE job_input END END AS job_name,
  CASE WHEN error IS NULL THEN rid END AS run_id,
  CASE WHEN error IS NULL THEN cid END AS cluster_id,
  CASE WHEN error IS NULL THEN env END AS env,
  CASE WHEN error IS NULL THEN destination || '/' || cid END AS base_path,
  CASE WHEN error IS NULL THEN rstart END AS start_time,
  CASE WHEN error IS NULL THEN rend END AS end_time,
  error
FROM r5""",
    }
