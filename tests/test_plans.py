"""Physical plan checks: pushdown, pruning, join strategies, top-k."""

from __future__ import annotations

import re

import pytest

from helpers import SF_MID
from jobmix.functions.rules import FIXTURE_BU_RULES
from jobmix.plans import registry
from jobmix.plans import reports as D
from jobmix.sources import Tables
from jobmix.sources.fixtures import derive_tables
from jobmix.sources.layout import write_tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def inp(spark):
    return registry.inputs(spark, SF_MID)


@pytest.mark.parametrize("name", list(D.DATASETS))
def test_no_cartesian_or_nested_loop_join(inp, name):
    p = plan(D.DATASETS[name](inp, registry.DEFAULT))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_time_filter_and_column_pruning_reach_the_scan(inp):
    text = formatted(D.kpi_headline(inp, registry.DEFAULT))
    scans = re.findall(r"Scan parquet.*?ReadSchema: (struct<[^\n]*>)", text, re.S)
    assert any("l_shipdate" in s for s in scans)
    assert "GreaterThanOrEqual(l_shipdate,1995-01-01T00:00)" in text
    assert "LessThan(l_shipdate,2002-01-01T00:00)" in text
    # the run scan reads 4 of lineitem's 11 columns
    run_scan = [s for s in scans if "l_shipdate" in s][0]
    assert run_scan.count(":") == 4


def test_usage_date_filter_pushed(inp):
    text = formatted(D.spend_kpi(inp, registry.DEFAULT))
    assert "PushedFilters: [IsNotNull(l_shipdate)" in text


@pytest.mark.parametrize("name", ["job_table", "serverless_job_table"])
def test_top_k_without_global_sort(inp, name):
    p = plan(D.DATASETS[name](inp, registry.DEFAULT))
    assert "TakeOrderedAndProject" in p


def test_dimensions_broadcast_when_small(inp):
    p = plan(D.kpi_headline(inp, registry.DEFAULT))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_shuffle_join_path_when_broadcast_forbidden(spark, inp):
    spark.conf.set("jobmix.broadcast.maxBytes", "1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = D.kpi_headline(inp, registry.DEFAULT)
        p = formatted(df)
        assert "SortMergeJoin" in p or "ShuffledHashJoin" in p
        # the shuffle join keys non-classic entries by a spread hash, not NULL
        assert "xxhash64" in p
    finally:
        spark.conf.unset("jobmix.broadcast.maxBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_python_udfs(inp):
    for name, fn in D.DATASETS.items():
        p = plan(fn(inp, registry.DEFAULT))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stored"))
    write_tables(derive_tables(spark, SF_MID), root, by_day=False, files=2)
    return D.Inputs(Tables.from_parquet(spark, root), FIXTURE_BU_RULES)


@pytest.fixture
def no_broadcast(spark):
    conf = {"jobmix.broadcast.maxBytes": "1", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def nodes(df) -> list[str]:
    return re.findall(r"(\w+)(?: \w+)? \(\d+\)", formatted(df).split("\n\n")[0])


def scans_of(df, table: str) -> int:
    return len(re.findall(rf"Location: .*/{table}\]", formatted(df)))


def test_backlog_plan_is_lean(stored):
    """One scan of the timeline, no arrays, no window and no Expand; two of the exchanges are the dimensions'."""
    df = D.job_table(stored, registry.DEFAULT)
    names = nodes(df)
    assert scans_of(df, "runs") == 1
    assert names.count("Exchange") <= 6 and names.count("BroadcastExchange") == 3
    assert not {"Window", "Expand", "ObjectHashAggregate"} & set(names)
    assert "collect_" not in formatted(df)


def test_backlog_without_broadcasts(stored, no_broadcast):
    assert nodes(D.job_table(stored, registry.DEFAULT)).count("Exchange") <= 11


@pytest.mark.parametrize("name", ["bu_trend", "time_series_counts", "time_series_pct", "kpi_headline"])
def test_only_flags_are_shuffled(stored, name):
    """A broadcast lookup needs no exchange of entries: one of flags, by job (and week), then the result's own."""
    df = D.DATASETS[name](stored, registry.DEFAULT)
    exchanges = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", formatted(df))
    with_entries = [e for e in exchanges if "cluster_id" in e and "ap_rows" not in e and "count" not in e]
    assert with_entries == [] and scans_of(df, "runs") == 1
    # The dimension's own, the flags', and what the result is grouped and sorted by.
    assert nodes(df).count("Exchange") <= 4


def test_lookup_leaves_out_clusters_that_tell_nothing(make_tables):
    from jobmix.operators.runs import told_kinds
    t = make_tables(clusters=[("w", "a", "JOB"), ("w", "b", "UI"), ("w", "c", "JOB"), ("w", "c", None),
                              ("w", "d", "API"), ("w", "d", "JOB"), ("w", None, "UI")])
    assert sorted(map(tuple, told_kinds(t.clusters).collect())) == [
        ("w", "b", 1, 0), ("w", "c", 0, 2), ("w", "d", 1, 1)]


def test_serverless_list_has_one_name_lookup(inp):
    text = formatted(D.serverless_job_table(inp, registry.DEFAULT))
    assert "Window" not in text.split("\n\n")[0]


def test_scale_conf_sizes_partitions_to_input():
    from jobmix.session import scale_conf
    conf = scale_conf(100 * 1024 ** 4)          # 100 TB
    assert int(conf["spark.sql.shuffle.partitions"]) == 409_600
    conf = scale_conf(10 * 1024 ** 3)           # 10 GB
    assert int(conf["spark.sql.shuffle.partitions"]) == 40
    assert conf["spark.sql.files.maxPartitionBytes"] == str(256 * 1024 * 1024)


def test_explicit_zero_forbids_a_broadcast(spark):
    from jobmix.operators.joins import fits_broadcast
    assert fits_broadcast(spark.range(1)) and not fits_broadcast(spark.range(1), 0)
