"""DuckDB SQL for each registered query (the correctness oracle).

Written independently of the DataFrame code: the adapter, parsing and merge
are re-stated in plain SQL over the pre-registered driver tables. Only the
fixed values (patterns, word lists) are shared, as literals.
"""

from __future__ import annotations

from logloom import rules
from logloom.plans import catalog as C
from logloom.sources import adapter as A


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(expr: str, mapping: dict, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {_q(str(k)) if isinstance(k, str) else k} THEN {_q(v)}" for k, v in mapping.items())
    return f"CASE {expr} {whens}" + (f" ELSE {default}" if default else "") + " END"


# DuckDB (RE2) has no (?U); the adapter text is ASCII, so ASCII classes agree.
_LEVEL_RE = r"\b(ERROR|WARN(?:ING)?|INFO|DEBUG)\b"
_TS1 = r"(\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})"
_TS2 = r"\[(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3})[+\-]\d{4}\]"
_TS3 = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3})"

_LINE = f"""CASE WHEN event_id % 8 = 5 THEN
      CASE WHEN event_id % 2 = 0 THEN {_q(A.STACK_LINE)} ELSE {_q(A.TRACEBACK_LINE)} END
    ELSE concat_ws(' ',
      CASE event_id % 8 WHEN 3 THEN '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '+0200]'
                        WHEN 4 THEN strftime(ts, '%Y-%m-%d %H:%M:%S,%g')
                        ELSE strftime(ts, '%y/%m/%d %H:%M:%S') END,
      {_case('event_type', A.LEVEL_WORD_BY_EVENT)},
      CASE WHEN event_id % 8 = 6 THEN {_q(A.NOISE_MESSAGE)}
           ELSE {_case('event_id % 11', A.MESSAGES_BY_EVENT_MOD_11, _q(A.DEFAULT_MESSAGE))} END
        || CAST(user_id AS VARCHAR))
  END"""

ENTRIES_CTE = f"""raw_lines AS (
  SELECT
    'run-' || CAST(user_id % 4 AS VARCHAR) AS run_key,
    CASE WHEN user_id % 5 = 0 THEN 'driver' ELSE 'executor' END AS source_type,
    CASE WHEN user_id % 5 = 0 THEN '' ELSE CAST(user_id % 5 - 1 AS VARCHAR) END AS source_detail,
    CASE WHEN user_id % 5 = 0 THEN NULL ELSE {_q(A.APP_ID)} END AS app_id,
    CASE WHEN event_id % 3 = 0 THEN 'stdout' ELSE 'stderr' END AS stream,
    event_id AS line_no,
    {_LINE} AS line,
    ts AS event_ts
  FROM events
),
entries AS (
  SELECT *,
    '/logs/' || run_key || CASE WHEN source_type = 'driver' THEN '/driver/' || stream
      ELSE '/executor/{A.APP_ID}/' || source_detail || '/' || stream END AS file_origin,
    coalesce(
      try_strptime(nullif(regexp_extract(line, '{_TS1}', 1), ''), '%y/%m/%d %H:%M:%S'),
      try_strptime(nullif(regexp_extract(line, '{_TS2}', 1), ''), '%Y-%m-%dT%H:%M:%S.%g'),
      try_strptime(nullif(regexp_extract(line, '{_TS3}', 1), ''), '%Y-%m-%d %H:%M:%S,%g')) AS ts,
    CASE regexp_extract(line, '{_LEVEL_RE}', 1)
      WHEN 'ERROR' THEN 40 WHEN 'WARN' THEN 30 WHEN 'WARNING' THEN 30 WHEN 'INFO' THEN 20 WHEN 'DEBUG' THEN 10
    END AS level
  FROM raw_lines
)"""

def keyed_cte(src: str = "entries", rot: str = "NULL") -> str:
    """Merge keys over ``src``: file first stamp, running max, file order
    (``rot`` is the file's rotation time, NULL for active files)."""
    return f"""file_first AS (
  SELECT run_key, file_origin, arg_min(ts, line_no) FILTER (WHERE ts IS NOT NULL) AS first_ts
  FROM {src} GROUP BY run_key, file_origin
),
keyed0 AS (
  SELECT e.*, coalesce(e.ts, f.first_ts, TIMESTAMP '0001-01-01 00:00:00') AS ts_key,
    CASE WHEN e.source_type = 'executor' AND regexp_matches(e.source_detail, '^[0-9]{{1,18}}$')
         THEN CAST(e.source_detail AS BIGINT) ELSE 0 END AS exec_num,
    {rot} AS rot
  FROM {src} e JOIN file_first f USING (run_key, file_origin)
),
keyed AS (
  SELECT *,
    max(ts_key) OVER (PARTITION BY run_key, file_origin ORDER BY line_no
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS merge_ts,
    dense_rank() OVER (PARTITION BY run_key ORDER BY source_type = 'executor', exec_num,
                       coalesce(app_id, ''), source_detail, stream,
                       coalesce(rot, TIMESTAMP '9999-12-31 23:59:59'), file_origin) AS file_idx
  FROM keyed0
),"""


# The log tree written by the file-scan queries: one file per run, source,
# stream and day; the lines of its one damaged archive are lost.
TREE_CTE = f"""entries_tree AS (
  SELECT * REPLACE (file_origin || '--' || strftime(event_ts, '%Y-%m-%d') || '--00'
                    || CASE WHEN source_type = 'driver' THEN '-00' ELSE '' END AS file_origin),
         date_trunc('day', event_ts) AS rot_start
  FROM entries
  WHERE NOT (source_type = 'executor' AND day(event_ts) = {A.DAMAGED_DAY} AND run_key = '{A.DAMAGED_RUN}'
             AND source_detail = '{A.DAMAGED_SOURCE}' AND stream = '{A.DAMAGED_STREAM}')
)"""

KEYED_CTE = keyed_cte() + """

ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run_key ORDER BY merge_ts, file_idx, line_no) AS merge_rank
  FROM keyed
)"""


# Events: a stamped line and the lines without stamp behind it, with the last
# cause among these, else the exception the stamped line names.
EVENTS_CTE = f"""chained AS (
  SELECT * REPLACE (CASE WHEN line <> '{A.STACK_LINE}' THEN line
    WHEN line_no % 7 < 3 THEN 'Caused by: org.acme.Fault' || line_no % 7 || 'Exception: event ' || line_no
    WHEN line_no % 7 = 3 THEN 'acme.RangeError: event ' || line_no ELSE line END AS line) FROM keyed
),
linked AS (
  SELECT *, max(CASE WHEN ts IS NOT NULL THEN line_no END) OVER (
      PARTITION BY run_key, file_origin ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS event_line,
    CASE WHEN ts IS NOT NULL THEN NULL WHEN line LIKE 'Caused by: %' THEN substr(line, 12)
         WHEN line LIKE 'acme.RangeError: %' THEN line END AS link
  FROM chained
),
events0 AS (
  SELECT run_key, file_origin, source_type, source_detail, event_line, min(merge_ts) AS merge_ts,
    max(CASE WHEN ts IS NOT NULL THEN level END) AS level, max(CASE WHEN ts IS NOT NULL THEN line END) AS head,
    count(*) AS n_lines, count(link) AS n_causes, arg_max(link, line_no) FILTER (WHERE link IS NOT NULL) AS link,
    string_agg(line, chr(10) ORDER BY line_no) AS text
  FROM linked GROUP BY ALL
),
log_events AS (
  SELECT *, coalesce(link, nullif(regexp_extract(coalesce(head, ''), '(?:[A-Za-z0-9]+[.])*[A-Z][A-Za-z0-9]*(?:Error|Exception): .*', 0), '')) AS cause
  FROM events0
)"""


# Templates: masked messages through the tree (token count, three tokens), then
# the places below; a crowded node or place is a wildcard.
def _templates() -> str:
    masked = r"regexp_replace(line, '^\[?[0-9]{2,4}[-/][0-9]{2}[-/][0-9]{2}[T ][0-9:.,]+(?:[+-][0-9]{4}\])?[ \t]*', '')"
    for pattern, mark in (
            (r'"[^"]*"', "<str>"), (r"\b0x[0-9a-fA-F]+\b|\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b", "<hex>"),
            (r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?\b", "<ip>"),
            (r"(?:\b[a-z][a-z0-9]*:/?)?(?:/[A-Za-z0-9_.@%+=-]+){2,}/?", "<path>"), (r"\b[0-9]+(?:\.[0-9]+)?\b", "<num>"),
            (r"[ \t]+", " ")):
        masked = f"regexp_replace({masked}, '{pattern}', '{mark}', 'g')"
    ctes = [f"""named AS (
  SELECT * REPLACE (regexp_replace(line, 'user ([0-9]+)$', 'user u\\1') AS line) FROM entries
)""", f"""said AS (SELECT *, trim({masked}) AS message FROM named)""",
            "level0 AS (SELECT DISTINCT message, string_split(message, ' ') AS t, [len(string_split(message, ' '))::VARCHAR] AS node FROM said)"]
    for i in range(3):
        ctes.append(f"""level{i + 1} AS (
  SELECT message, t, list_append(node, CASE WHEN len(t) <= {i} THEN '' WHEN many > {C.TEMPLATE_CHILDREN} THEN '<*>' ELSE t[{i + 1}] END) AS node
  FROM (SELECT *, count(DISTINCT t[{i + 1}]) OVER (PARTITION BY node) AS many FROM level{i})
)""")
    ctes.append(f"""spread_out AS (SELECT message, node, t, unnest(range(1, len(t) + 1)) AS i FROM level3),
placed AS (
  SELECT message, node, i, CASE WHEN i <= 3 THEN node[i + 1]
    WHEN count(DISTINCT t[i]) OVER (PARTITION BY node, i) > {C.TEMPLATE_CHILDREN} THEN '<*>' ELSE t[i] END AS token
  FROM spread_out
),
templates AS (
  SELECT message, string_agg(token, ' ' ORDER BY i) AS template FROM placed GROUP BY message
),
template_counts AS (
  SELECT run_key, substr(sha256(template), 1, 16) AS template_id, template, count(*) AS n_lines,
    count(DISTINCT CASE WHEN source_type = 'executor' THEN app_id || '/' || source_detail END) AS n_executors,
    count(DISTINCT source_type || ':' || source_detail) AS n_sources
  FROM said JOIN templates USING (message) GROUP BY run_key, template
)""")
    return ",\n".join(ctes)


def iso(col: str) -> str:
    return (f"(strftime({col}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime({col}, '%f') = '000000' THEN '' "
            f"ELSE '.' || strftime({col}, '%f') END || '+00:00')")


def _noise(col: str = "line") -> str:
    regs = rules.THREAD_DUMP_PATTERNS + rules.JVM_STARTUP_PATTERNS + rules.PYSPARK_GATEWAY_PATTERNS
    parts = [f"regexp_matches({col}, {_q(r)})" for r in regs]
    parts += [f"strpos({col}, {_q(s)}) > 0" for s in rules.SPARK_NOISE_SUBSTRINGS]
    return "(" + " OR ".join(parts) + ")"


def _label() -> str:
    return "CASE WHEN source_type = 'driver' THEN 'driver:' || stream ELSE 'exec/' || source_detail || ':' || stream END"


def _level_name(col: str = "level") -> str:
    return f"CASE {col} WHEN 40 THEN 'ERROR' WHEN 30 THEN 'WARN' WHEN 20 THEN 'INFO' WHEN 10 THEN 'DEBUG' END"


def _classes() -> str:
    """(run, line, class) rows for ERROR/WARN lines, one per matching rule."""
    rows = ", ".join(f"({p}, {_q(c)}, {_q(r)})" for p, c, r in rules.ROOT_CAUSE_RULES)
    return f"""rules(prio, root_cause, pattern) AS (VALUES {rows}),
classified AS (
  SELECT e.*, r.root_cause FROM entries e JOIN rules r ON regexp_matches(e.line, r.pattern)
  WHERE e.level IN (40, 30)
),
class_counts AS (
  SELECT run_key, root_cause, count(*) AS n_lines,
         count(DISTINCT source_type || ':' || source_detail) AS n_sources
  FROM classified GROUP BY run_key, root_cause
)"""


def _w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _tail_filter(where: str, n: int, desc: bool = True, per_run: bool = True) -> str:
    order = "merge_ts DESC, file_idx DESC, line_no DESC" if desc else "merge_ts, file_idx, line_no"
    part = "PARTITION BY run_key " if per_run else ""
    return f"""SELECT * FROM (
  SELECT *, row_number() OVER ({part}ORDER BY {order}) AS rn FROM keyed WHERE {where}
) WHERE rn {'<=' if n > 0 else '>'} {abs(n)}"""


def log_oracles() -> dict[str, str]:
    E, K = ENTRIES_CTE, KEYED_CTE
    src_detail = C.SOURCE.split(":")[1]
    levels = ", ".join(str(rules.LEVEL_WORDS[x.strip().upper()]) for x in C.LEVELS.split(","))
    text = (f"'[' || rpad({_label()}, CAST(greatest(12, length({_label()})) AS INTEGER), ' ') || ' ' || "
            f"coalesce(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '{' ' * 19}') || '] ' || line")

    def js(expr: str) -> str:
        return f"coalesce(to_json({expr}), 'null')"

    json = ("'{\"source_type\": ' || " + js("source_type") + " || ', \"source_detail\": ' || " + js("source_detail")
            + " || ', \"stream\": ' || " + js("stream") + " || ', \"timestamp\": ' || " + js(iso("ts"))
            + " || ', \"level\": ' || " + js(_level_name()) + " || ', \"file\": ' || " + js("file_origin")
            + " || ', \"line\": ' || " + js("line") + " || '}'")
    ok = f"NOT {_noise()}"
    pairs = ", ".join(f"({_q(a)}, {_q(b)})" for a, b in C.COMPARE_PAIRS)
    actions = ", ".join(f"({_q(c)}, {_q(a)})" for c, a in rules.SUGGESTED_ACTIONS)
    nb = "[^\\t\\n\\x0b\\x0c\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
    brk = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"
    return {
        "parse_timestamp": _w(E) + f"SELECT line_no, {iso('ts')} AS ts_iso FROM entries",
        "parse_level": _w(E) + f"SELECT line_no, level, {_level_name()} AS level_name FROM entries",
        "split_lines": f"""SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, line FROM (
  SELECT doc_id, unnest(parts) AS line, unnest(generate_series(1, len(parts))) AS pos
  FROM (SELECT doc_id, regexp_split_to_array(text, '{brk}') AS parts FROM documents)
) WHERE regexp_matches(line, '{nb}')""",
        "source_filter": _w(E) + "SELECT run_key, line_no, source_detail FROM entries "
        f"WHERE source_type = 'executor' AND source_detail = {_q(src_detail)}",
        "stream_filter": _w(E) + f"SELECT run_key, line_no, stream FROM entries WHERE stream = {_q(C.STREAM)}",
        "level_filter": _w(E) + f"SELECT line_no, level FROM entries WHERE level IN ({levels})",
        "since_filter": _w(E) + f"SELECT line_no, {iso('ts')} AS ts_iso FROM entries "
        f"WHERE ts IS NOT NULL AND ts >= TIMESTAMP '{C.SINCE.replace('T', ' ')}'",
        "focus_filter": _w(E) + f"SELECT run_key, line_no FROM entries WHERE {ok}",
        "focus_report": _w(E) + f"SELECT run_key, count(*) FILTER (WHERE {_noise()}) AS removed, "
        f"count(*) FILTER (WHERE {ok}) AS remaining FROM entries GROUP BY run_key",
        "grep_filter": _w(E) + f"SELECT line_no, line FROM entries WHERE regexp_matches(line, {_q(C.GREP)})",
        "file_first_timestamp": _w(E) + f"""SELECT run_key, file_origin,
  coalesce({iso("arg_min(ts, line_no) FILTER (WHERE ts IS NOT NULL)")}, '0001-01-01T00:00:00+00:00') AS first_ts
FROM entries GROUP BY run_key, file_origin""",
        "merge_order": _w(E, K) + f"SELECT run_key, line_no, file_origin, {iso('merge_ts')} AS merge_ts, "
        "merge_rank FROM ranked",
        "tail": _w(E, K) + "SELECT run_key, line_no, line FROM ("
        + _tail_filter(f"{ok} AND level IN (40, 30)", C.TAIL_N) + ")",
        "tail_per_run": _w(E, K) + "SELECT run_key, line_no, line FROM ("
        + _tail_filter(ok, C.TAIL_PER_RUN_N) + ")",
        "skip_head": _w(E, K) + "SELECT run_key, line_no FROM ("
        + _tail_filter("level = 40", -C.SKIP_HEAD_N, desc=False) + ")",
        "tail_large": _w(E, K) + "SELECT run_key, line_no FROM (" + _tail_filter("level = 30", C.TAIL_LARGE_N) + ")",
        "format_text": _w(E) + f"SELECT run_key, line_no, {text} AS text FROM entries",
        "format_jsonl": _w(E) + f"SELECT run_key, line_no, {json} AS json FROM entries",
        "errors_per_executor": _w(E) + "SELECT run_key, source_detail, count(*) AS n_errors FROM entries "
        "WHERE level = 40 AND source_type = 'executor' GROUP BY run_key, source_detail",
        "errors_by_source": _w(E) + "SELECT run_key, source_type, source_detail, level, count(*) AS n_lines, "
        f"{_level_name()} AS level_name FROM entries WHERE level IN (40, 30) "
        "GROUP BY run_key, source_type, source_detail, level",
        "root_cause_counts": _w(E, _classes()) + "SELECT * FROM class_counts",
        "events": _w(E, K, EVENTS_CTE) + """SELECT run_key, file_origin, event_line, level, head, n_lines, n_causes, cause,
  split_part(cause, ':', 1) AS cause_class, text FROM log_events""",
        "cause_spread": _w(E, K, EVENTS_CTE) + f"""SELECT run_key, split_part(cause, ':', 1) AS cause_class, count(*) AS n_events,
  count(DISTINCT source_type || ':' || source_detail) AS n_sources, {iso('min(merge_ts)')} AS first_seen
FROM log_events WHERE cause IS NOT NULL GROUP BY ALL""",
        "template_spread": _w(E, _templates(), """executors AS (
  SELECT run_key, count(DISTINCT CASE WHEN source_type = 'executor' THEN app_id || '/' || source_detail END)::INT AS executor_count
  FROM entries GROUP BY run_key)""") + """SELECT *, CASE WHEN n_executors = 0 THEN 'driver_only' WHEN n_executors = executor_count THEN 'systemic'
  WHEN n_executors = 1 THEN 'single' ELSE 'partial' END AS spread FROM template_counts JOIN executors USING (run_key)""",
        "template_compare": _w(E, _templates()) + f"""SELECT base_run, current_run, template_id, template,
  coalesce(sum(n_lines) FILTER (WHERE run_key = base_run), 0)::BIGINT AS n_base,
  coalesce(sum(n_lines) FILTER (WHERE run_key = current_run), 0)::BIGINT AS n_current,
  CASE WHEN n_base = 0 THEN 'new' WHEN n_current = 0 THEN 'gone' ELSE 'common' END AS status
FROM (VALUES {", ".join(str(p) for p in C.COMPARE_PAIRS)}) v(base_run, current_run)
JOIN template_counts ON run_key IN (base_run, current_run) GROUP BY ALL""",
        "first_error": _w(E, K) + f"""SELECT run_key,
  CASE WHEN ts IS NULL THEN NULL ELSE {iso('ts')} END AS first_error_time,
  source_type, source_detail, stream, line, file_origin, line_no, n_errors
FROM (SELECT *, row_number() OVER (PARTITION BY run_key ORDER BY merge_ts, file_idx, line_no) AS rn,
             count(*) OVER (PARTITION BY run_key) AS n_errors
      FROM keyed WHERE level = 40) WHERE rn = 1""",
        "executor_spread": _w(E, _classes()) + """, exec_counts AS (
  SELECT run_key, CAST(count(DISTINCT CASE WHEN source_type = 'executor' THEN app_id || '/' || source_detail END)
         AS INTEGER) AS executor_count FROM entries GROUP BY run_key
), per_class AS (
  SELECT run_key, root_cause,
    CAST(count(DISTINCT CASE WHEN source_type = 'executor' THEN app_id || '/' || source_detail END) AS INTEGER)
      AS n_executors, count(*) AS n_lines
  FROM classified GROUP BY run_key, root_cause
)
SELECT p.run_key, p.root_cause, p.n_executors, p.n_lines, x.executor_count,
  CASE WHEN p.n_executors = 0 THEN 'driver_only' WHEN p.n_executors = x.executor_count THEN 'systemic'
       WHEN p.n_executors = 1 THEN 'single' ELSE 'partial' END AS spread
FROM per_class p LEFT JOIN exec_counts x USING (run_key)""",
        "run_compare": _w(E, _classes(), f"pairs(base_run, current_run) AS (VALUES {pairs})") + """SELECT
  coalesce(b.base_run, c.base_run) AS base_run, coalesce(b.current_run, c.current_run) AS current_run,
  coalesce(b.root_cause, c.root_cause) AS root_cause, b.n_lines AS n_base, c.n_lines AS n_current,
  CASE WHEN b.n_lines IS NULL THEN 'new' WHEN c.n_lines IS NULL THEN 'gone' ELSE 'common' END AS status
FROM (SELECT p.base_run, p.current_run, k.root_cause, k.n_lines FROM pairs p JOIN class_counts k
      ON k.run_key = p.base_run) b
FULL OUTER JOIN (SELECT p.base_run, p.current_run, k.root_cause, k.n_lines FROM pairs p JOIN class_counts k
      ON k.run_key = p.current_run) c
ON b.base_run = c.base_run AND b.current_run = c.current_run AND b.root_cause = c.root_cause""",
        "error_timeline": _w(E) + f"""SELECT run_key, {iso('min(ts)')} AS run_start, {iso('max(ts)')} AS run_end,
  {iso('min(ts) FILTER (WHERE level = 40)')} AS first_error, {iso('max(ts) FILTER (WHERE level = 40)')} AS last_error,
  (epoch_us(min(ts) FILTER (WHERE level = 40)) - epoch_us(min(ts))) // 1000000 AS secs_to_first_error,
  (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS run_secs
FROM entries GROUP BY run_key""",
        "suggested_actions": _w(E, _classes(), f"actions(root_cause, action) AS (VALUES {actions})")
        + f"""SELECT k.run_key, k.root_cause, k.n_lines, coalesce(a.action, {_q(rules.UNCLEAR_ACTION)}) AS action
FROM class_counts k LEFT JOIN actions a USING (root_cause)""",
        "scan_tree": _w(E, TREE_CTE) + f"""SELECT run_key AS run, source_type, source_detail, stream, line, level,
  CASE WHEN ts IS NULL THEN NULL ELSE {iso('ts')} END AS ts_iso FROM entries_tree""",
        "query_logs_tree": _w(E, TREE_CTE, keyed_cte("entries_tree", "rot_start").rstrip(","))
        + "SELECT run_key AS run, source_type, source_detail, stream, line FROM ("
        + _tail_filter(f"{ok} AND level IN (40, 30)", C.TAIL_N) + ")",
        "flagship": _w(E, K) + f"""SELECT run_key, row_number() OVER (PARTITION BY run_key
    ORDER BY merge_ts, file_idx, line_no) AS merge_rank, line_no, {text} AS text
FROM ({_tail_filter(f"{ok} AND level IN (40, 30)", 50)})""",
    }


def all_oracles() -> dict[str, str]:
    from logloom.plans.oracle_runs import listing_cte, run_oracles
    from logloom.plans.oracle_tree import tree_oracles

    return {**log_oracles(), **run_oracles(), **tree_oracles(f"WITH {listing_cte()} SELECT path FROM listing")}
