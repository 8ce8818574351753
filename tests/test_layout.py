"""Date-partitioned storage: same results, and the range prunes partitions."""

from __future__ import annotations

import dataclasses
import re

import pytest

from helpers import classic, price_row, run, srv, usage_row
from jobmix.functions.rules import FIXTURE_BU_RULES
from jobmix.params import Params, TimeRange
from jobmix.plans import reports as D
from jobmix.sources import Tables
from jobmix.sources.layout import bucket_skew, write_bucketed, write_tables

WS = [("w1", "w-market-prod-r1"), ("w2", "w-risk-dev-r1")]
CLUSTERS = [("w1", "ap", "UI"), ("w1", "jc", "JOB")]
DAYS = [f"2024-01-{d:02d}" for d in range(1, 15)]


@pytest.fixture(scope="module")
def tables(spark):
    from jobmix import schemas
    runs = []
    usage = []
    for i, day in enumerate(DAYS):
        runs.append(run("w1", f"j{i % 3}", f"r{i}", f"{day} 08:00:00",
                        [srv()] if i % 2 else [classic("ap" if i % 5 == 0 else "jc")], duration=60 * i))
        runs.append(run("w2", "j9", f"s{i}", f"{day} 23:59:59", [srv(), classic("jc")]))
        usage.append(usage_row(day, "w1", "JOBS", i % 2 == 0, i + 1, job=f"j{i % 3}"))
        usage.append(usage_row(day, "w2", "ALL_PURPOSE", None, 2))
    data = {"workspaces": WS, "runs": runs, "clusters": CLUSTERS, "jobs": [("w1", "j0", "zero")],
            "usage": usage, "prices": [price_row("SKU_1", "2024-01-01 00:00:00", None, "0.5")]}
    return Tables(**{k: spark.createDataFrame(v, schemas.ALL_TABLES[k]) for k, v in data.items()})


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    write_tables(tables, root)
    return D.Inputs(Tables.from_parquet(spark, root), FIXTURE_BU_RULES)


def test_schema_of_stored_tables(stored):
    assert stored.tables.check() == {}


@pytest.mark.parametrize("name", sorted(D.DATASETS))
def test_same_results_from_partitioned_storage(tables, stored, name):
    p = Params(TimeRange("2024-01-03", "2024-01-10"))
    a = sorted(map(tuple, D.DATASETS[name](D.Inputs(tables, FIXTURE_BU_RULES), p).collect()))
    b = sorted(map(tuple, D.DATASETS[name](stored, p).collect()))
    assert a == b


def test_range_prunes_partitions(stored):
    p = Params(TimeRange("2024-01-03", "2024-01-04"))
    text = D.kpi_headline(stored, p)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_day_utc" in text
    spend = D.spend_kpi(stored, p)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(usage_date" in spend
    rows = D.kpi_headline(stored, p).collect()[0]
    assert rows.total_jobs == 3


def test_rows_survive_any_mix_of_time_zones(spark, tables, tmp_path):
    """Written under two zones and read under a third, every run table is as from the plain frame."""
    p = Params(TimeRange("2024-01-03", "2024-01-10"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    names = [n for n in D.DATASETS if n not in ("spend_kpi", "serverless_job_table", "param_bu", "param_env")]
    try:
        roots = []
        for i, writer in enumerate(("America/New_York", "Asia/Tokyo")):
            spark.conf.set("spark.sql.session.timeZone", writer)
            roots.append(str(tmp_path / str(i)))
            write_tables(tables, roots[-1])
        for reader in ("UTC", "Pacific/Auckland"):
            spark.conf.set("spark.sql.session.timeZone", reader)
            for name in names:
                want = sorted(map(tuple, D.DATASETS[name](D.Inputs(tables, FIXTURE_BU_RULES), p).collect()))
                for root in roots:
                    inp = D.Inputs(Tables.from_parquet(spark, root), FIXTURE_BU_RULES)
                    assert sorted(map(tuple, D.DATASETS[name](inp, p).collect())) == want, (reader, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_files_of_a_day_do_not_grow_with_the_writing_tasks(spark, tables, tmp_path):
    import glob
    many = Tables(**{k: getattr(tables, k).repartition(16) for k in ("workspaces", "runs", "clusters", "jobs",
                                                                     "usage", "prices")})
    write_tables(many, str(tmp_path / "t"))
    for table in ("runs", "usage"):
        days = glob.glob(str(tmp_path / "t" / table / "*=*"))
        files = glob.glob(str(tmp_path / "t" / table / "*=*" / "part-*"))
        assert len(days) == len(DAYS) and len(files) <= 2 * len(days)


@pytest.fixture(scope="module")
def bucketed(spark, tables, tmp_path_factory):
    spark.sql(f"CREATE DATABASE bucketed LOCATION '{tmp_path_factory.mktemp('bucketed')}'")
    yield D.Inputs(Tables.from_catalog(spark, write_bucketed(tables, "bucketed", 2)), FIXTURE_BU_RULES)
    spark.sql("DROP DATABASE bucketed CASCADE")


@pytest.mark.parametrize("name", sorted(D.DATASETS))
def test_same_results_from_bucketed_storage(tables, bucketed, name):
    p = Params(TimeRange("2024-01-03", "2024-01-10"))
    a = sorted(map(tuple, D.DATASETS[name](D.Inputs(tables, FIXTURE_BU_RULES), p).collect()))
    assert a == sorted(map(tuple, D.DATASETS[name](bucketed, p).collect()))


@pytest.mark.parametrize("name", ["kpi_headline", "bu_scorecard", "time_series_counts", "bu_trend"])
def test_classification_of_bucketed_runs_needs_no_exchange_by_job(stored, bucketed, name):
    p = Params(TimeRange("2024-01-03", "2024-01-10"))
    plan = lambda inp: D.DATASETS[name](inp, p)._jdf.queryExecution().executedPlan().toString()
    by_day, by_job = plan(stored), plan(bucketed)
    assert "job_id" in "".join(re.findall(r"Exchange hashpartitioning\(([^)]*)", by_day))
    assert by_job.count("Exchange hashpartitioning") == by_day.count("Exchange hashpartitioning") - 1
    assert "PartitionFilters: [isnotnull(run_day_utc" in by_job and "Bucketed: true" in by_job


def test_a_hot_job_is_not_bucketed(spark, tables):
    from jobmix import schemas
    hot = spark.createDataFrame([run("w1", "hot", f"r{i}", "2024-01-05 08:00:00", [srv()]) for i in range(100)]
                                + [run("w1", f"j{i}", f"s{i}", "2024-01-05 08:00:00", [srv()]) for i in range(200)],
                                schemas.ALL_TABLES["runs"])
    assert bucket_skew(hot, 64) > 20 and bucket_skew(hot.limit(0), 64) == 0
    with pytest.raises(ValueError, match="store by day"):
        write_bucketed(dataclasses.replace(tables, runs=hot), "default", 64)
