"""Merge order, distributed rank, tail."""

import datetime as dt
import heapq

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.operators.merge import merge_sort_cols, rank_within, tail, with_merge_keys

UTC = dt.timezone.utc
FLOOR = dt.datetime.min.replace(tzinfo=UTC)
SCHEMA = ("run_key string, source_type string, source_detail string, app_id string, stream string, "
          "file_timestamp timestamp, file_origin string, line_no bigint, timestamp timestamp, line string")


def t(m):
    return None if m is None else dt.datetime(2026, 3, 11, 12, 0, tzinfo=UTC) + dt.timedelta(minutes=m)


def make(spark, files, run="r"):
    """files: list of lists of minute offsets (None = no timestamp); file i is executor i."""
    rows = []
    for fi, mins in enumerate(files):
        for li, m in enumerate(mins):
            rows.append((run, "executor", str(fi), "app-1", "stderr", None, f"/{run}/f{fi}", li, t(m), f"{fi}:{li}"))
    return spark.createDataFrame(rows, SCHEMA)


def expected(files):
    """The heap merge of the per-file streams, keyed (ts or file's first ts or year 1, file, line)."""
    its = []
    for fi, mins in enumerate(files):
        first = next((t(m) for m in mins if m is not None), FLOOR)
        its.append([((t(m) or first, fi, li), f"{fi}:{li}") for li, m in enumerate(mins)])
    return [x for _, x in heapq.merge(*its, key=lambda p: p[0])]


def merged(spark, files, block_rows=1 << 20):
    df = with_merge_keys(make(spark, files), block_rows=block_rows)
    return [r.line for r in df.orderBy(*merge_sort_cols()).collect()]


def test_interleave(spark):
    assert merged(spark, [[1, 3], [2, 4]]) == ["0:0", "1:0", "0:1", "1:1"]


def test_null_inherits_file_first(spark):
    assert merged(spark, [[1, None], [2]]) == ["0:0", "0:1", "1:0"]


def test_file_without_timestamps_first(spark):
    assert merged(spark, [[1], [None, None]]) == ["1:0", "1:1", "0:0"]


def test_out_of_order_stays_with_predecessor(spark):
    # a: 1, 5, null ; b: 2 -> a1 b2 a5 a-null (a plain sort would differ)
    assert merged(spark, [[1, 5, None], [2]]) == ["0:0", "1:0", "0:1", "0:2"]


files_st = st.lists(st.lists(st.one_of(st.none(), st.integers(0, 30)), min_size=0, max_size=8),
                    min_size=1, max_size=4)


@settings(max_examples=25, deadline=None)
@given(files_st)
def test_property_equals_heap_merge(spark, files):
    assert merged(spark, files) == expected(files)


@settings(max_examples=15, deadline=None)
@given(files_st)
def test_two_level_blocks_equal_one_level(spark, files):
    assert merged(spark, files, block_rows=2) == expected(files)


def test_rank_within_matches_row_number(spark):
    files = [[i % 7 for i in range(40)], [None] + [i % 5 for i in range(30)], [3] * 25]
    df = with_merge_keys(make(spark, files), block_rows=4).repartition(5)
    ranked = rank_within(df, ["run_key"], merge_sort_cols()[1:], "rk")
    got = [r.line for r in ranked.orderBy("rk").collect()]
    assert got == expected(files)
    assert [r.rk for r in ranked.orderBy("rk").collect()] == list(range(1, 97))


def test_tail_variants(spark):
    files = [[i for i in range(0, 20, 2)], [i for i in range(1, 20, 2)]]
    order = expected(files)
    df = make(spark, files)

    def lines_of(d):
        d = with_merge_keys(d) if "merge_ts" not in d.columns else d
        return [r.line for r in d.orderBy(*merge_sort_cols()).collect()]

    assert lines_of(tail(df, 3)) == order[-3:]
    assert lines_of(tail(df, 3, per_run=False)) == order[-3:]
    assert lines_of(tail(df, 0)) == order
    assert lines_of(tail(df, None)) == order
    assert lines_of(tail(df, -3)) == order[3:]
    assert lines_of(tail(df, -3, per_run=False)) == order[3:]
    assert lines_of(tail(df, 1500)) == order
    assert lines_of(tail(df, 1500, per_run=False)) == order


def test_tail_per_run(spark):
    a = make(spark, [[1, 2, 3]], run="a")
    b = make(spark, [[5, 6]], run="b")
    out = tail(a.unionByName(b), 1).select("run_key", "line").collect()
    assert sorted((r.run_key, r.line) for r in out) == [("a", "0:2"), ("b", "0:1")]


def test_file_order(spark):
    from logloom.operators.merge import with_file_order

    rows = [("r", p, st, app, sd, stream, ts) for p, st, app, sd, stream, ts in [
        ("/r/executor/app-1/10/stderr", "executor", "app-1", "10", "stderr", None),
        ("/r/executor/app-1/2/stderr", "executor", "app-1", "2", "stderr", None),
        ("/r/executor/app-1/x/stderr", "executor", "app-1", "x", "stderr", None),
        ("/r/driver/stderr", "driver", None, "", "stderr", None),
        ("/r/driver/stderr--2026-03-11--18-00", "driver", None, "", "stderr", t(0)),
        ("/r/driver/stderr--2026-03-11--17-00", "driver", None, "", "stderr", t(-60)),
        ("/r/driver/stdout", "driver", None, "", "stdout", None),
    ]]
    df = spark.createDataFrame(rows, "run_key string, path string, source_type string, app_id string, "
                                     "source_detail string, stream string, file_timestamp timestamp")
    got = [r.path for r in with_file_order(df).orderBy("file_idx").collect()]
    assert got == ["/r/driver/stderr--2026-03-11--17-00", "/r/driver/stderr--2026-03-11--18-00", "/r/driver/stderr",
                   "/r/driver/stdout", "/r/executor/app-1/x/stderr", "/r/executor/app-1/2/stderr",
                   "/r/executor/app-1/10/stderr"]


def test_hot_file_many_blocks(spark, monkeypatch):
    """One file with most of the rows, split into 40 blocks (14 groups), plus small files."""
    monkeypatch.setattr("logloom.operators.merge.BLOCKS_PER_GROUP", 3)
    import random

    rnd = random.Random(7)
    hot = [None if rnd.random() < 0.2 else rnd.randint(0, 500) for _ in range(4000)]
    files = [hot, [rnd.randint(0, 500) for _ in range(50)], [None, 3, None, 400]]
    df = with_merge_keys(make(spark, files), block_rows=100, num_partitions=8)
    got = [r.line for r in df.orderBy(*merge_sort_cols()).select("line").collect()]
    assert got == expected(files)


def test_rank_hot_group_spans_partitions(spark):
    rows = [("hot", i) for i in range(3000)] + [("cold", i) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, k bigint")
    ranked = rank_within(df, ["g"], [F.col("k")], "rk")
    got = {(r.g, r.k): r.rk for r in ranked.collect()}
    assert all(got[("hot", i)] == i + 1 for i in range(3000))
    assert all(got[("cold", i)] == i + 1 for i in range(10))


def test_large_tails_equal_the_sorted_order(spark):
    """Selection of the n-th row: ties over files and blocks, any n, from both
    ends, per run and over all runs; also a run that is one single key."""
    import random

    rnd = random.Random(9)
    runs = {r: [[rnd.choice([None, *range(span)]) for _ in range(rnd.randrange(1, 60))] for _ in range(rnd.randrange(1, 5))]
            for r, span in (("a", 4), ("b", 200), ("c", 1))}
    runs["d"] = [[None] * 30, [None] * 30]
    df = None
    for run, files in runs.items():
        one = make(spark, files, run)
        df = one if df is None else df.unionByName(one)
    from logloom.operators import merge

    keyed = with_merge_keys(df, block_rows=5).cache()
    order = {r: [f"{r}{x}" for x in expected(files)] for r, files in runs.items()}
    everything = [x for r in sorted(order) for x in order[r]]
    for n in (1, 7, 40, 61, 100, 10_000, -1, -13, -59, -200, -10_000):
        got = {f"{r.run_key}{r.line}" for r in merge._last_rows(keyed, merge._wanted(keyed, n, True), "line_no").collect()}
        assert got == {x for r in order.values() for x in (r[-n:] if n > 0 else r[-n:])}, n
        got = [f"{r.run_key}{r.line}" for r in merge._last_rows(keyed, merge._wanted(keyed, n, False), "line_no").collect()]
        assert sorted(got) == sorted(everything[-n:]), n
