"""Hot keys: one workspace, one job and one cluster hold a third of the rows.

Results must not depend on the join strategy, and a shuffled cluster lookup
spreads the hot cluster over the partitions.
"""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import classic, run, srv, usage_row
from jobmix.functions.rules import FIXTURE_BU_RULES
from jobmix.operators import runs as R
from jobmix.params import Params, TimeRange
from jobmix.plans import reports as D

P = Params(TimeRange("2024-01-01", "2024-03-31"))
NAMES = {"kpi_headline", "job_table", "bu_scorecard", "time_series_counts", "serverless_job_table",
         "spend_kpi"}


@pytest.fixture(scope="module")
def skewed(spark):
    from jobmix import schemas
    from jobmix.sources import Tables
    ws = [(f"w{i}", f"w-{'market' if i % 2 else 'risk'}-{'prod' if i % 3 else 'dev'}-r1") for i in range(20)]
    clusters = [("w0", "hot", "UI")] + [(f"w{i}", f"c{j}", "JOB") for i in range(20) for j in range(5)]
    runs, usage = [], []
    n = 3000
    for k in range(n):
        day = f"2024-{1 + k % 3:02d}-{1 + k % 28:02d} {k % 24:02d}:00:00"
        if k % 3 == 0:   # the hot third: one workspace, one job, one cluster
            runs.append(run("w0", "hot_job", f"h{k}", day, [classic("hot")], duration=k % 90))
            usage.append(usage_row(day[:10], "w0", "JOBS", True, 1, job="hot_job"))
        else:
            w = f"w{1 + k % 19}"
            runs.append(run(w, f"j{k % 50}", f"r{k}", day,
                            [srv()] if k % 2 else [classic(f"c{k % 5}")], duration=k % 70))
            usage.append(usage_row(day[:10], w, "JOBS", k % 2 == 0, 2, job=f"j{k % 50}"))
    data = {"workspaces": ws, "runs": runs, "clusters": clusters, "jobs": [("w0", "hot_job", "big")],
            "usage": usage, "prices": []}
    return D.Inputs(Tables(**{k: spark.createDataFrame(v, schemas.ALL_TABLES[k])
                              for k, v in data.items()}), FIXTURE_BU_RULES)


def _results(inp):
    return {name: sorted(map(tuple, D.DATASETS[name](inp, P).collect())) for name in NAMES}


def test_hot_keys_same_result_on_both_join_paths(spark, skewed):
    expected = _results(skewed)
    conf = {"jobmix.broadcast.maxBytes": "1",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = _results(skewed)
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert got == expected
    hot = [r for r in expected["job_table"] if r[3] == "hot_job"][0]
    assert hot[6] == 1000  # run_count of the hot job: every third run


def test_hot_job_is_one_job(skewed):
    h = D.kpi_headline(skewed, P).collect()[0]
    assert h.jobs_all_purpose >= 1
    sc = {r.bu: r.total_jobs for r in D.bu_scorecard(skewed, P).collect()}
    assert sum(sc.values()) == h.total_jobs


def test_a_hot_cluster_is_split(spark):
    """A shuffled lookup: the hot third of the entries is not read by one task."""
    n = 30_000
    entries = spark.range(0, n, 1, 8).selectExpr(
        "if(id % 3 = 0, 'w0', concat('w', id % 50)) AS workspace_id", "concat('j', id) AS job_id",
        "if(id % 3 = 1 AND id % 2 = 0, 'SERVERLESS_COMPUTE', 'CLASSIC_COMPUTE') AS compute_type",
        "if(id % 3 = 0, 'hot', concat('c', id % 997)) AS cluster_id")
    clusters = spark.createDataFrame([("w0", "hot", "UI"), ("w1", "c1", "JOB"), ("w0", "hot", "JOB")],
                                     "workspace_id string, cluster_id string, cluster_source string")
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = (R.bucket_runs(entries, clusters, broadcast=False).withColumn("task", F.spark_partition_id())
                .groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cluster_id") == "hot").alias("hot"),
                                     F.count_if(F.col("bucket") == "AP").alias("ap"))).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # Each hot entry matches the cluster's interactive and its other row.
    assert sum(r.hot for r in rows) == 2 * n // 3 and sum(r.ap for r in rows) == n // 3
    assert len(rows) > 20 and max(r.n for r in rows) < 4 * sum(r.n for r in rows) / 24


def test_a_job_of_many_clusters(spark, make_tables):
    """The backlog of a job with a cluster for each of its 200,000 runs: no buffer holds its days or clusters."""
    n = 200_000
    base = make_tables(workspaces=[("w1", "w-risk-prod-r1")], clusters=[("w1", "c7", "UI")], jobs=[("w1", "big", "a name")])
    runs = spark.range(0, n, 1, 4).selectExpr(
        "'w1' AS workspace_id", "'big' AS job_id", "concat('r', id) AS job_run_id",
        "timestamp'2024-01-01 23:59:59' + make_dt_interval(int(id % 75)) AS period_start_time",
        "id % 120 AS execution_duration_seconds",
        "array(named_struct('type', 'CLASSIC_COMPUTE', 'cluster_id', concat('c', id))) AS compute")
    tables = type(base)(base.workspaces, runs, base.clusters, base.jobs, base.usage, base.prices)
    df = D.job_table(D.Inputs(tables, FIXTURE_BU_RULES), P)
    row = df.collect()[0]
    assert (row.run_count, row.active_days, row.compute_bucket, row.job_name) == (
        n, 75, "JOBS_ON_ALL_PURPOSE", "a name")
    assert str(row.last_run_date) == "2024-03-15" and row.avg_runtime_min == 1.0
    assert "collect_" not in df._jdf.queryExecution().executedPlan().toString()
