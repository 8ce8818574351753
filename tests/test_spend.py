from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import price_row, usage_row
from jobmix.functions.rules import FIXTURE_BU_RULES
from jobmix.operators import spend as S
from jobmix.params import Params, TimeRange
from jobmix.plans import reports as D

RANGE = TimeRange("2024-01-01", "2024-12-31")
P = Params(RANGE)
WS = [("w1", "w-market-prod-r1"), ("w2", "w-risk-dev-r1")]


def _priced(t, rate="1.0"):
    rows = S.price_usage(t.usage, t.prices, RANGE, rate=rate).collect()
    return sorted((str(r.date), r.bucket, r.revenue) for r in rows)


def test_price_validity_interval_bounds(make_tables):
    t = make_tables(
        prices=[price_row("SKU_1", "2024-01-01 00:00:00", "2024-07-01 00:00:00", "0.10"),
                price_row("SKU_1", "2024-07-01 00:00:00", None, "0.20")],
        usage=[
            # usage end equal to a price start: that price applies
            usage_row("2024-07-01", "w1", "JOBS", True, 10, end="2024-07-01 00:00:00"),
            # just before the boundary: the earlier price
            usage_row("2024-06-30", "w1", "JOBS", True, 10, end="2024-06-30 23:59:59"),
            # far into the open-ended price
            usage_row("2024-12-31", "w1", "JOBS", True, 10, end="2024-12-31 12:00:00"),
        ])
    assert _priced(t) == [("2024-06-30", "SRV", Decimal("1.0000000000")),
                          ("2024-07-01", "SRV", Decimal("2.0000000000")),
                          ("2024-12-31", "SRV", Decimal("2.0000000000"))]


def test_no_price_costs_zero_and_rate_multiplies(make_tables):
    t = make_tables(
        prices=[price_row("SKU_1", "2024-01-01 00:00:00", None, "0.50")],
        usage=[usage_row("2024-03-01", "w1", "JOBS", False, 4),
               usage_row("2024-03-01", "w1", "JOBS", False, 4, sku="SKU_X")])
    got = [(b, float(r)) for _, b, r in _priced(t, rate="0.8")]
    assert sorted(got) == [("JC", 0.0), ("JC", 1.6)]


def test_overlapping_prices_double_count(make_tables):
    t = make_tables(
        prices=[price_row("SKU_1", "2024-01-01 00:00:00", None, "0.50"),
                price_row("SKU_1", "2024-02-01 00:00:00", None, "0.25")],
        usage=[usage_row("2024-03-01", "w1", "ALL_PURPOSE", None, 4)])
    assert [float(r) for *_, r in _priced(t)] == [1.0, 2.0]


def test_usage_date_range_is_closed(make_tables):
    t = make_tables(usage=[usage_row("2023-12-31", "w1", "JOBS", True, 1),
                           usage_row("2024-01-01", "w1", "JOBS", True, 1),
                           usage_row("2024-12-31", "w1", "JOBS", True, 1),
                           usage_row("2025-01-01", "w1", "JOBS", True, 1)])
    assert [x[0] for x in _priced(t)] == ["2024-01-01", "2024-12-31"]


def test_spend_kpi_buckets_and_null_serverless_flag(make_tables):
    t = make_tables(
        workspaces=WS,
        prices=[price_row("SKU_1", "2024-01-01 00:00:00", None, "1.00")],
        usage=[usage_row("2024-02-01", "w1", "JOBS", True, 2),
               usage_row("2024-02-01", "w1", "JOBS", False, 3),
               usage_row("2024-02-01", "w1", "JOBS", None, 100),     # in no column
               usage_row("2024-02-01", "w2", "ALL_PURPOSE", None, 5),
               usage_row("2024-02-01", "w2", "SQL", True, 1000)])    # product not counted
    row = D.spend_kpi(D.Inputs(t, FIXTURE_BU_RULES), P).collect()[0]
    assert (row.serverless_spend, row.classic_jobs_spend, row.all_purpose_total_spend) == (2.0, 3.0, 5.0)
    row = D.spend_kpi(D.Inputs(t, FIXTURE_BU_RULES), Params(RANGE, bu=("Risk",))).collect()[0]
    assert (row.serverless_spend, row.classic_jobs_spend, row.all_purpose_total_spend) == (None, None, 5.0)


def test_serverless_usage_per_job(make_tables):
    t = make_tables(usage=[
        usage_row("2024-02-01", "w1", "JOBS", True, "1.5", job="j1"),
        usage_row("2024-03-05", "w1", "JOBS", True, "2.25", job="j1"),
        usage_row("2024-03-05", "w1", "JOBS", True, 7, job=None),      # no job id
        usage_row("2024-03-05", "w1", "JOBS", False, 7, job="j1"),     # classic
        usage_row("2024-03-05", "w1", "JOBS", None, 7, job="j1"),      # unknown flag
    ])
    rows = S.serverless_usage(t.usage, RANGE).collect()
    assert [(r.job_id, r.serverless_dbus, str(r.first_usage), str(r.last_usage)) for r in rows] == [
        ("j1", Decimal("3.750"), "2024-02-01", "2024-03-05")]


def test_serverless_job_table_collapses_shared_names(make_tables):
    # two workspace ids share one name; equal aggregates collapse into one row
    t = make_tables(
        workspaces=[("w1", "w-x-prod-r1"), ("w2", "w-x-prod-r1")],
        jobs=[("w1", "j", "alpha"), ("w2", "j", "beta"), ("w2", "j", "aardvark")],
        usage=[usage_row("2024-02-01", "w1", "JOBS", True, 2, job="j"),
               usage_row("2024-02-01", "w2", "JOBS", True, 2, job="j")])
    rows = D.serverless_job_table(D.Inputs(t, FIXTURE_BU_RULES), P).collect()
    assert [(r.workspace_name, r.job_id, r.job_name, r.serverless_dbus) for r in rows] == [
        ("w-x-prod-r1", "j", "beta", 2.0)]


def test_overlapping_prices_are_found(spark):
    from jobmix import schemas
    from jobmix.operators.spend import overlapping_prices
    rows = [price_row("A", "2024-01-01 00:00:00", "2024-02-01 00:00:00", "1"),
            price_row("A", "2024-02-01 00:00:00", None, "2"),
            price_row("B", "2024-01-01 00:00:00", None, "1"),
            price_row("B", "2024-03-01 00:00:00", "2024-04-01 00:00:00", "3")]
    found = overlapping_prices(spark.createDataFrame(rows, schemas.LIST_PRICES)).collect()
    assert [(r.sku_name, str(r.price_start_time)) for r in found] == [("B", "2024-03-01 00:00:00")]


def test_schema_check_wants_only_what_is_read(spark):
    from jobmix import schemas
    wide = spark.sql("""select current_date() usage_date, current_timestamp() usage_end_time, 'w' workspace_id, 's' sku_name,
        'u' usage_unit, cast(1 as decimal(38,18)) usage_quantity, 'JOBS' billing_origin_product,
        struct(true as is_serverless, 1 as photon) product_features, struct('j' as job_id) usage_metadata,
        map('a','b') custom_tags, 5 extra""").schema
    assert schemas.conforms(wide, schemas.USAGE) == []
    bad = spark.sql("select struct(1 as is_serverless) product_features").schema
    problems = schemas.conforms(bad, schemas.USAGE)
    assert "missing usage_date" in problems
    assert any(p.startswith("product_features.is_serverless") for p in problems)


@pytest.fixture
def no_broadcast(spark):
    conf = {"jobmix.broadcast.maxBytes": "0", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def test_prices_by_month_bins(make_tables, no_broadcast):
    """A shuffled price lookup: bounds inside and at the ends of months, open and empty prices, use out of the range."""
    prices = [("A", "2023-06-10", "2024-01-15 12:00:00", "1"), ("A", "2024-01-15 12:00:00", "2024-03-01", "2"),
              ("A", "2024-03-01", None, "3"), ("B", "2020-01-01", None, "5"), ("C", "2024-02-02", "2024-02-02", "7")]
    used = [("A", "2024-01-01", None), ("A", "2024-01-15", "2024-01-15 11:59:59"), ("A", "2024-01-15", "2024-01-15 12:00:00"),
            ("A", "2024-02-29", "2024-02-29 23:59:59"), ("A", "2024-02-29", "2024-03-01 00:00:00"),
            ("A", "2024-03-31", "2024-07-09 00:00:00"), ("A", "2024-01-01", "2023-02-01 00:00:00"),
            ("B", "2024-01-01", "2019-01-01 00:00:00"), ("B", "2024-03-31", "2031-01-01 00:00:00"),
            ("C", "2024-02-02", "2024-02-02 00:00:00")]
    t = make_tables(usage=[usage_row(day, "w", "JOBS", True, 10 ** i, sku=sku, end=end)
                           for i, (sku, day, end) in enumerate(used)],
                    prices=[price_row(*p) for p in prices])
    df = S.price_usage(t.usage, t.prices, TimeRange("2024-01-01", "2024-03-31"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "_p_bin" in plan
    got = sorted(int(r.revenue) for r in df.collect())
    each = [1, 1, 2, 2, 3, 3, 0, 0, 5, 0]
    assert got == sorted(n * 10 ** i for i, n in enumerate(each))


def test_a_hot_sku_is_split_by_months(spark, make_tables, no_broadcast):
    """Half of the usage on one SKU: months and adaptive splits spread it over the tasks."""
    n = 40_000
    base = make_tables()
    usage = spark.range(0, n, 1, 8).selectExpr(
        "date_add(date'2024-01-01', int(id % 360)) AS usage_date",
        "timestamp(date_add(date'2024-01-01', int(id % 360))) AS usage_end_time", "concat('w', id) AS workspace_id",
        "if(id % 2 = 0, 'HOT', concat('S', id % 40)) AS sku_name", "'DBU' AS usage_unit",
        "cast(1 AS decimal(18,3)) AS usage_quantity", "'JOBS' AS billing_origin_product",
        "named_struct('is_serverless', true) AS product_features")
    prices = spark.createDataFrame([price_row(s, "2024-01-01", None, 2) for s in ("HOT", *(f"S{i}" for i in range(40)))],
                                   base.prices.schema)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        tasks = (S.price_usage(usage, prices, TimeRange("2024-01-01", "2024-12-31"))
                 .groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("r")).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(t.n for t in tasks) == n and sum(t.r for t in tasks) == 2 * n
    assert len(tasks) == 12 and max(t.n for t in tasks) < 3 * n / 12
