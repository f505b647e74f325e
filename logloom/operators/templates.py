"""Message templates (A5, A6 beyond the fixed classes): what lines have in
common once their variable parts are taken out.

Variable parts of a known shape (times, numbers, addresses, paths, quoted text)
are masked first, and equal masked messages are counted once, however many lines
they have. Their tokens then run through a parse tree of fixed depth: by number
of tokens, then by the first ``DEPTH`` tokens; a node with more than ``children``
different tokens below it has one child instead, a wildcard. Below a leaf every
further place is a wildcard if it has more than ``children`` different tokens
there. A node is decided by the set of tokens that reach it, so the result does
not depend on the order or the partitioning of the lines, and more lines only
ever turn tokens into wildcards.

Each level is a grouped distinct count over the different masked messages; what
is joined back is a row per node that turned into a wildcard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.session import write_and_read

DEPTH = 3
CHILDREN = 16
WILDCARD = "<*>"
# FIXED VALUES (own): the stamp at a line's head, then masked shapes in order
STAMP = r"^\[?[0-9]{2,4}[-/][0-9]{2}[-/][0-9]{2}[T ][0-9:.,]+(?:[+-][0-9]{4}\])?[ \t]*"
MASKS = [
    (r'"[^"]*"', "<str>"),
    (r"\b0x[0-9a-fA-F]+\b|\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b", "<hex>"),
    (r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?\b", "<ip>"),
    (r"(?:\b[a-z][a-z0-9]*:/?)?(?:/[A-Za-z0-9_.@%+=-]+){2,}/?", "<path>"),
    (r"\b[0-9]+(?:\.[0-9]+)?\b", "<num>"),
]


def masked_message(line: Column | str) -> Column:
    """A line without its stamp and with its variable shapes masked, its tokens
    joined by one space."""
    text = F.regexp_replace(F.col(line) if isinstance(line, str) else line, STAMP, "")
    for pattern, mark in MASKS:
        text = F.regexp_replace(text, pattern, mark)
    return F.trim(F.regexp_replace(text, r"[ \t]+", " "))


def _crowded(rows: DataFrame, keys: list[str], token: str, children: int) -> DataFrame:
    """The keys with more than ``children`` different tokens."""
    return rows.groupBy(*keys, token).agg(F.lit(1).alias("_one")).groupBy(*keys).agg(
        F.count("*").alias("_n")).where(F.col("_n") > children).select(*keys, F.lit(True).alias("_wild"))


def mine_templates(entries: DataFrame, depth: int = DEPTH, children: int = CHILDREN) -> DataFrame:
    """(message, template_id, template) of every different masked message."""
    spark = entries.sparkSession
    found = entries.select(masked_message("line").alias("message")).groupBy("message").agg(F.count("*").alias("n_lines"))
    found = found.withColumn("tokens", F.split("message", " ")).withColumn("node", F.size("tokens").cast("string"))
    found = write_and_read(spark, found, "messages")
    for level in range(depth):
        token = F.get("tokens", F.lit(level))
        here = found.withColumn("_token", token)
        wild = _crowded(here.where(F.col("_token").isNotNull()), ["node"], "_token", children)
        here = here.join(wild, "node", "left").withColumn("_token", F.when(F.col("_wild"), F.lit(WILDCARD)).otherwise(F.col("_token")))
        found = here.withColumn("node", F.concat_ws(" ", "node", F.coalesce("_token", F.lit("")))).drop("_token", "_wild")
    # the places below the leaves, all at once
    places = found.select("node", F.posexplode("tokens").alias("_place", "_token")).where(F.col("_place") >= depth)
    wild = _crowded(places, ["node", "_place"], "_token", children).groupBy("node").agg(F.collect_set("_place").alias("_wild"))
    found = found.join(wild, "node", "left")
    head = F.slice(F.split("node", " "), F.lit(2), F.least(F.size("tokens"), F.lit(depth)))
    rest = F.transform("tokens", lambda t, i: F.when(F.array_contains("_wild", i), F.lit(WILDCARD)).otherwise(t))
    rest = F.slice(rest, F.lit(depth + 1), F.greatest(F.size("tokens") - depth, F.lit(0)))
    found = found.withColumn("template", F.array_join(F.concat(head, rest), " "))
    return found.select("message", F.substring(F.sha2("template", 256), 1, 16).alias("template_id"), "template")


def with_templates(entries: DataFrame, templates: DataFrame) -> DataFrame:
    """Entries with ``template_id`` and ``template``."""
    return entries.withColumn("message", masked_message("line")).join(templates, "message", "left").drop("message")


def template_counts(entries: DataFrame, templates: DataFrame) -> DataFrame:
    """(run_key, template_id, template, n_lines, n_executors, n_sources), the
    lines counted by message before they meet their template."""
    executor = F.when(F.col("source_type") == "executor", F.concat_ws("/", "app_id", "source_detail"))
    lines = entries.select("run_key", masked_message("line").alias("message"), executor.alias("executor"),
                           F.concat_ws(":", "source_type", "source_detail").alias("source"))
    lines = lines.groupBy("run_key", "message", "executor", "source").agg(F.count("*").alias("n"))
    return lines.join(templates, "message").groupBy("run_key", "template_id", "template").agg(
        F.sum("n").alias("n_lines"), F.countDistinct("executor").alias("n_executors"), F.countDistinct("source").alias("n_sources"))


def template_spread(counts: DataFrame, executors: DataFrame) -> DataFrame:
    """``spread`` of every template over the executors of its run (A5);
    ``executors``: (run_key, executor_count)."""
    n, total = F.col("n_executors"), F.col("executor_count")
    spread = F.when(n == 0, "driver_only").when(n == total, "systemic").when(n == 1, "single").otherwise("partial")
    return counts.join(executors, "run_key", "left").withColumn("spread", spread)


def template_compare(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Templates of two runs side by side (A6): new, gone or common, with their
    lines; ``pairs``: (base_run, current_run)."""
    c = counts.select("run_key", "template_id", "template", "n_lines")
    both = pairs.select("base_run", "current_run", F.explode(F.array("base_run", "current_run")).alias("run_key")).join(c, "run_key")
    side = lambda which: F.coalesce(F.sum(F.when(F.col("run_key") == F.col(which), F.col("n_lines"))), F.lit(0))
    out = both.groupBy("base_run", "current_run", "template_id", "template").agg(
        side("base_run").alias("n_base"), side("current_run").alias("n_current"))
    status = F.when(F.col("n_base") == 0, "new").when(F.col("n_current") == 0, "gone").otherwise("common")
    return out.withColumn("status", status)
