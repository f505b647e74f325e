"""Message templates."""

import random

from pyspark.sql import functions as F

from logloom.operators import templates as T

SCHEMA = "run_key string, source_type string, source_detail string, app_id string, line string"


def brute(messages, depth, children):
    """message -> template, straight from the definition."""
    tokens = {m: m.split(" ") for m in messages}
    node = {m: (len(t),) for m, t in tokens.items()}
    for i in range(depth):
        below = {}
        for m, t in tokens.items():
            below.setdefault(node[m], set()).update(t[i:i + 1])
        node = {m: (*node[m], "<*>" if len(below[node[m]]) > children and len(t) > i else "".join(t[i:i + 1])) for m, t in tokens.items()}
    places = {}
    for m, t in tokens.items():
        for i, x in enumerate(t[depth:]):
            places.setdefault((node[m], i), set()).add(x)
    return {m: " ".join([*node[m][1:1 + min(depth, len(t))],
                         *("<*>" if len(places[node[m], i]) > children else x for i, x in enumerate(t[depth:]))]) for m, t in tokens.items()}


def test_masks(spark):
    cases = {
        '26/03/11 18:00:01 WARN Lost task 3.0 in stage 12 (TID 44, 10.0.0.7:7337)': "WARN Lost task <num> in stage <num> (TID <num>, <ip>)",
        '[2026-03-11T21:01:07.016+0000] [heap] took 9 ms': "[heap] took <num> ms",
        '2026-03-11 21:00:01,234 INFO read  dbfs:/mnt/a/b.parquet "x y"': "INFO read <path> <str>",
        "task 0xff00 of 01234567-89ab-cdef-0123-456789abcdef\tdone": "task <hex> of <hex> done",
        "u17 stays": "u17 stays", "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "line string")
    assert {r.line: r.m for r in df.select("line", T.masked_message("line").alias("m")).collect()} == cases


def test_templates_equal_the_definition_however_lines_are_dealt(spark):
    rnd = random.Random(1)
    words = ["a", "b", "c", "d", "e", "f"]
    lines = [" ".join(rnd.choice(words[:rnd.choice([1, 2, 6])]) for _ in range(rnd.randrange(1, 8))) for _ in range(300)]
    lines += [f"user u{i} logged in from x{i}" for i in range(30)] + ["user u1 logged out from x2"] + [""]
    rows = [("r", "executor", "0", "a", x) for x in lines]
    for depth, children, parts in ((3, 2, 1), (3, 2, 7), (2, 4, 3), (0, 3, 2)):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        got = {r.message: r.template for r in T.mine_templates(df, depth, children).collect()}
        assert got == brute(set(lines), depth, children)
    assert T.mine_templates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spread_and_comparison(spark):
    rows = [("r1", "executor", str(i % 3), "a", f"failed for u{i} at once") for i in range(30)]
    rows += [("r1", "executor", "1", "a", "disk is full"), ("r1", "driver", "", None, "driver says no more")]
    rows += [("r2", "executor", "0", "a", "disk is full")] * 2 + [("r2", "executor", "1", "a", "failed for u99 at once")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = T.mine_templates(df, children=5)
    counts = T.template_counts(df, found)
    executors = df.where("source_type = 'executor'").groupBy("run_key").agg(F.countDistinct("source_detail").cast("int").alias("executor_count"))
    got = {(r.run_key, r.template): (r.n_lines, r.spread) for r in T.template_spread(counts, executors).collect()}
    assert got == {("r1", "failed for <*> at once"): (30, "systemic"), ("r1", "disk is full"): (1, "single"),
                   ("r1", "driver says no more"): (1, "driver_only"), ("r2", "disk is full"): (2, "single"),
                   ("r2", "failed for <*> at once"): (1, "single")}
    pairs = spark.createDataFrame([("r1", "r2")], "base_run string, current_run string")
    got = {r.template: (r.n_base, r.n_current, r.status) for r in T.template_compare(counts, pairs).collect()}
    assert got == {"failed for <*> at once": (30, 1, "common"), "disk is full": (1, 2, "common"), "driver says no more": (1, 0, "gone")}
    tagged = T.with_templates(df, found)
    assert tagged.where("template is null").count() == 0 and tagged.count() == len(rows)
