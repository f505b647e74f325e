"""logloom: cluster job logs as Spark DataFrames.

Entry points: ``plans.query.query_logs`` (read, merge, filter log trees),
``plans.query.triage`` (triage tables), ``sources.files.discover`` (file
table), ``operators.runs.resolve_runs`` (job/run lookup), and the command
line ``python -m logloom``.
"""

__version__ = "0.1.0"
