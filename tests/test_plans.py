"""Scale properties of the physical plans (checked on the smallest tables)."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan_of(spark, name):
    df = QUERIES[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_evaluation(spark, name):
    plan = plan_of(spark, name)
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas|PythonUDF", plan)


def test_tail_reduces_before_shuffle(spark):
    plan = plan_of(spark, "tail_per_run")
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_merge_reads_once_and_shuffles_lines_by_block(spark, monkeypatch):
    from logloom.operators import merge

    written, write = {}, merge.write_and_read

    def spy(session, df, name):
        out = write(session, df, name)
        written[name] = df._jdf.queryExecution().executedPlan().toString()
        return out

    monkeypatch.setattr(merge, "write_and_read", spy)
    plan = plan_of(spark, "first_error")
    lines = written["merge-lines"]
    # lines are hash-partitioned by (run, file, block), never by (run, file) alone
    assert re.findall(r"hashpartitioning\(([^)]*)\)", lines) and all(
        re.match(r"run_key#\d+, file_origin#\d+, merge_block#\d+L?", x) for x in re.findall(r"hashpartitioning\(([^)]*)\)", lines))
    assert "events.parquet" in lines and "events.parquet" not in plan + written["merge-blocks"]


def test_first_error_partial_aggregate(spark):
    plan = plan_of(spark, "first_error")
    assert "partial_min_by" in plan


def test_latest_run_partial_aggregate(spark):
    plan = plan_of(spark, "latest_run")
    assert "partial_max_by" in plan
