"""Fixed values.

Everything in this module is a value that must stay exactly as written for
results to match the behaviour logloom re-implements: timestamp and level
patterns, file-name patterns, noise lists, triage rules and action texts.
They are kept together, in their natural order, as plain data. Regexes are
written in the Java dialect Spark uses; ``(?U)`` gives ``\\b`` and ``\\s``
their Unicode meaning.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: line timestamps (tried in this order, first match per pattern)
# ---------------------------------------------------------------------------
# Each pattern has one group: the stamp, at fixed character positions.
# 1. yy/MM/dd HH:mm:ss           two-digit year, 69..99 -> 19xx, else 20xx
TS_SHORT_YEAR = r"([0-9]{2}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})"
# 2. [yyyy-MM-ddTHH:mm:ss.SSS+hhmm]  offset matched, then ignored
TS_ISO_BRACKET = r"\[([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3})[+\-][0-9]{4}\]"
# 3. yyyy-MM-dd HH:mm:ss,SSS
TS_LOG4J = r"([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3})"
# Two-digit years below this value are 20xx, the rest 19xx.
SHORT_YEAR_PIVOT = 69

# ---------------------------------------------------------------------------
# FIXED VALUES: levels
# ---------------------------------------------------------------------------
LEVEL_PATTERN = r"(?U)\b(ERROR|WARN(?:ING)?|INFO|DEBUG)\b"
LEVEL_WORDS = {"ERROR": 40, "WARN": 30, "WARNING": 30, "INFO": 20, "DEBUG": 10}
LEVEL_NAMES = {40: "ERROR", 30: "WARN", 20: "INFO", 10: "DEBUG"}

# ---------------------------------------------------------------------------
# FIXED VALUES: line splitting (Python str.splitlines separators)
# ---------------------------------------------------------------------------
# \r\n first so that it counts as one break.
LINE_BREAKS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
# Separators the Hadoop line reader does not split on.
EXTRA_LINE_BREAKS = "[\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
# A line is kept when it has one character that is neither Unicode
# whitespace nor one of the information separators 0x1C-0x1F.
NON_BLANK = "(?U)[^\\s\u001c-\u001f]"

# ---------------------------------------------------------------------------
# FIXED VALUES: log file names
# ---------------------------------------------------------------------------
DRIVER_STDERR = r"^stderr(--([0-9]{4})-([0-9]{2})-([0-9]{2})--([0-9]{2})-?([0-9]{2}))?$"
DRIVER_STDOUT = r"^stdout(--([0-9]{4})-([0-9]{2})-([0-9]{2})--([0-9]{2})-?([0-9]{2}))?$"
EXECUTOR_STDERR = r"^stderr(--([0-9]{4})-([0-9]{2})-([0-9]{2})--([0-9]{2}))?(\.gz)?$"
EXECUTOR_STDOUT = r"^stdout(--([0-9]{4})-([0-9]{2})-([0-9]{2})--([0-9]{2}))?(\.gz)?$"
LOG4J_ACTIVE = r"^log4j-active\.log$"
LOG4J_ROTATED = r"^log4j-([0-9]{4})-([0-9]{2})-([0-9]{2})-([0-9]{2})\.log\.gz$"
STACKTRACE_ACTIVE = r"^stacktrace\.log$"
STACKTRACE_ROTATED = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})-([0-9]{2})\.stacktrace\.log\.gz$"
APP_DIR = r"^app-[0-9]{14}-[0-9]{4}$"

# ---------------------------------------------------------------------------
# FIXED VALUES: job URLs (tried in this order)
# ---------------------------------------------------------------------------
URL_PATTERNS = [
    r"/jobs/([0-9]+)/runs/([0-9]+)",
    r"/jobs/([0-9]+)",
    r"#job/([0-9]+)/run/([0-9]+)",
    r"#job/([0-9]+)",
]
URL_PREFIXES = ["http://", "https://"]

# ---------------------------------------------------------------------------
# FIXED VALUES: noise removed by the focus filter
# ---------------------------------------------------------------------------
JVM_STARTUP_PATTERNS = [
    r"OpenJDK.*warning.*deprecated",
    r"^SLF4J:",
    r"^ANTLR Tool version",
    r"^chown: invalid group",
    r"^WARNING.*terminally deprecated",
    r"^WARNING.*setSecurityManager",
    r"^WARNING.*Please consider reporting",
    r"^WARNING.*will be removed",
    r"SyntaxWarning: invalid escape",
]
THREAD_DUMP_PATTERNS = [
    r'^"[^"]+"\s+id=\d+\s+state=',
    r"^\s+at java\.base@",
    r"^\s+at app//",
    r"^\s+- (locked|waiting on) <0x",
    r"^\s+Locked synchronizers:",
]
SPARK_NOISE_SUBSTRINGS = [
    "ShuffleBlockFetcherIterator:",
    "Executor: Finished task",
    "CoarseGrainedExecutorBackend: Got assigned task",
    "BlockManager: Removing broadcast",
    "BlockManager: Removed broadcast",
    "MemoryStore: Block broadcast",
    "TorrentBroadcast: Reading broadcast variable",
    "TorrentBroadcast: Unpersisting TorrentBroadcast",
    "MapOutputTrackerWorker: Doing the fetch",
    "MapOutputTrackerWorker: Got the output locations",
    "CodeGenerator: Code generated in",
    "FilterCompat: Filtering using predicate",
    "S3AbortableInputStream: Not all bytes were read",
]
PYSPARK_GATEWAY_PATTERNS = [
    r"Connection to spark from PID",
    r"Initialized gateway on port",
    r"^Connected to spark\.$",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: triage root-cause classes (priority, class, pattern)
# ---------------------------------------------------------------------------
ROOT_CAUSE_RULES = [
    (1, "memory", r"OutOfMemoryError"),
    (2, "network_shuffle", r"Connection refused|ShuffleBlockFetcher|TransportChannelHandler"),
    (3, "missing_resource", r"RESOURCE_DOES_NOT_EXIST"),
    (4, "sql_schema", r"AnalysisException"),
    (5, "hanging_tasks", r"HangingTaskDetector"),
    (6, "file_conflict", r"FileNotFoundException|FileAlreadyExistsException"),
    (7, "job_aborted", r"SparkException: Job aborted"),
    (8, "python_error", r"Py4JJavaError"),
]

# FIXED VALUES: suggested actions per class
SUGGESTED_ACTIONS = [
    ("memory", "Increase executor/driver memory, check for data skew, reduce partition size"),
    ("network_shuffle", "Enable shuffle retry settings, check cluster health, increase shuffle partitions"),
    ("missing_resource", "Verify table/path exists, check permissions, check if upstream job ran"),
    ("sql_schema", "Fix column references, check for schema evolution, verify data types"),
    ("hanging_tasks", "Increase shuffle partitions, check for data skew, salting join keys"),
    ("file_conflict", "Check for overlapping job schedules, enable Delta conflict resolution"),
]
# When no action row matches.
UNCLEAR_ACTION = (
    "Check a specific executor's full logs, look at driver log4j, "
    "compare with a previous successful run, widen the log level"
)

# ---------------------------------------------------------------------------
# Cause chains (own values): a link of a Java chain, a line that ends a Python
# traceback or begins a Java one, an exception named inside a line
# ---------------------------------------------------------------------------
CAUSED_BY = r"^\s*Caused by: (.+)$"
RAISED = r"^((?:[A-Za-z_][\w$]*\.)*[A-Z][\w$]*(?:Error|Exception|Exit|Interrupt)(?:: .*)?)$"
NAMED_EXCEPTION = r"(?:[A-Za-z_][\w$]*\.)*[A-Z][\w$]*(?:Error|Exception)\b.*"
