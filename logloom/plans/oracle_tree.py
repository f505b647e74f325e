"""DuckDB SQL of the queries in ``catalog_tree.py``. The noise flags and the
fallback stamps are stated outright, not taken from ``rules.py``."""

from __future__ import annotations

from logloom.plans import catalog_tree as C
from logloom.plans.oracle import ENTRIES_CTE, KEYED_CTE, TREE_CTE, _w, iso, log_oracles
from logloom.plans.oracle_runs import _runs_cte
from logloom.sources import adapter as A


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tree_oracles(listing_sql: str) -> dict[str, str]:
    lines = C.NOISE_LINES + C.PLAIN_LINES
    values = ", ".join(f"({i}, {_q(x)}, {str(i < len(C.NOISE_LINES)).lower()})" for i, x in enumerate(lines))
    damaged = (f"source_type = 'executor' AND day(event_ts) = {A.DAMAGED_DAY} AND run_key = '{A.DAMAGED_RUN}' "
               f"AND source_detail = '{A.DAMAGED_SOURCE}' AND stream = '{A.DAMAGED_STREAM}'")
    since = C.SINCE_NOW.strftime("%Y-%m-%d %H:%M:%S")
    return {
        "discover_tree": _w(ENTRIES_CTE) + f"""SELECT run_key AS run, source_type, source_detail, stream,
  count(DISTINCT event_ts::DATE) AS n_files,
  count(DISTINCT CASE WHEN source_type = 'executor' AND day(event_ts) % {A.GZ_EVERY} = 0 THEN event_ts::DATE END) AS n_packed,
  strftime(min(date_trunc('day', event_ts)), '%Y-%m-%d %H:%M:%S') AS first_rotation
FROM entries GROUP BY run_key, source_type, source_detail, stream""",
        "skipped_files": _w(ENTRIES_CTE) + f"""SELECT DISTINCT run_key AS run, source_type, source_detail, stream,
  stream || '--' || strftime(event_ts, '%Y-%m-%d') || '--00.gz' AS name FROM entries WHERE {damaged}""",
        "pruned_tree": _w(ENTRIES_CTE, TREE_CTE) + f"""SELECT run_key AS run, source_type, source_detail, stream, line FROM entries_tree
WHERE ts >= TIMESTAMP '{C.PRUNE_SINCE.replace("T", " ")}' AND regexp_matches(line, '{C.PRUNE_GREP}')""",
        "file_stats": _w(ENTRIES_CTE, TREE_CTE) + f"""SELECT substr(file_origin, 7) || CASE WHEN source_type = 'executor'
    AND day(rot_start) % {A.GZ_EVERY} = 0 THEN '.gz' ELSE '' END AS file, count(*) AS n_lines,
  {iso('min(ts)')} AS first_ts, {iso('max(ts)')} AS last_ts, bool_or(line LIKE '%Traceback%') AS may_hold_traceback, false AS may_hold_others
FROM entries_tree GROUP BY file_origin, source_type, rot_start""",
        "follow_tree": _w(ENTRIES_CTE, TREE_CTE)
        + "SELECT run_key AS run, source_type, source_detail, stream, line FROM entries_tree WHERE level = 40",
        "follow_growing": _w(ENTRIES_CTE)
        + "SELECT run_key AS run, source_type, source_detail, stream, line FROM entries WHERE level = 40",
        "follow_merged": _w(ENTRIES_CTE, KEYED_CTE)
        + "SELECT run_key AS run, merge_rank, source_type, source_detail, stream, line, false AS late FROM ranked",
        "tail_one_stream": _w(ENTRIES_CTE, KEYED_CTE) + f"""SELECT run_key, line_no, line FROM keyed WHERE level = 40
ORDER BY run_key DESC, merge_ts DESC, file_idx DESC, line_no DESC LIMIT {C.TAIL_ONE_N}""",
        "write_read_jsonl": f"SELECT json FROM ({log_oracles()['format_jsonl']})",
        "run_timeline": _w(ENTRIES_CTE, _runs_cte(), f"""own AS (
  SELECT 'run-' || (run_id % {A.N_RUNS})::VARCHAR AS run_key, make_timestamp(min(start_time) * 1000) AS s,
         make_timestamp(max(end_time) * 1000) AS e FROM runs GROUP BY 1),
t AS (
  SELECT run_key, coalesce(any_value(own.s), min(ts)) AS s, coalesce(any_value(own.e), max(ts)) AS e,
         min(ts) FILTER (WHERE level = 40) AS f, max(ts) FILTER (WHERE level = 40) AS l
  FROM entries LEFT JOIN own USING (run_key) GROUP BY run_key)""") + f"""SELECT run_key, {iso('s')} AS run_start, {iso('e')} AS run_end,
  {iso('f')} AS first_error, {iso('l')} AS last_error,
  trunc((epoch_us(f) - epoch_us(s)) / 1000000)::BIGINT AS secs_to_first_error,
  trunc((epoch_us(e) - epoch_us(s)) / 1000000)::BIGINT AS run_secs FROM t""",
        "since_relative": _w(ENTRIES_CTE) + f"""SELECT line_no FROM entries
WHERE ts >= TIMESTAMP '{since}' - INTERVAL 36 HOUR""",
        "noise_patterns": _w(ENTRIES_CTE) + f"""SELECT line_no AS event_id,
  CASE WHEN front = {_q(C.WHOLE_LINE)} THEN front ELSE front || ' ' || line END AS line,
  noise OR (front <> {_q(C.WHOLE_LINE)} AND line LIKE '%Executor: Finished task%') AS noise
FROM raw_lines JOIN (VALUES {values}) v(i, front, noise) ON line_no % {len(lines)} = i""",
        "timestamp_fallbacks": """SELECT event_id, CASE event_id % 4
  WHEN 0 THEN (CASE WHEN event_id % 100 < 69 THEN '20' ELSE '19' END) || lpad((event_id % 100)::VARCHAR, 2, '0')
              || strftime(ts, '-%m-%dT%H:%M:%S') || '+00:00'
  WHEN 3 THEN NULL
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN millisecond(ts) % 1000 = 0 THEN ''
              ELSE '.' || lpad((millisecond(ts) % 1000)::VARCHAR, 3, '0') || '000' END || '+00:00'
  END AS ts_iso FROM events""",
        "listing_dbfs": f"SELECT DISTINCT path FROM ({listing_sql})",
    }
