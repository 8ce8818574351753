"""Telemetry tables derived from the TPC-H style test data.

The test data has no platform telemetry, so the six inputs are computed from
``supplier`` (workspaces) and ``lineitem`` (run entries, clusters, job names,
usage and prices) with plain column expressions.  Every table is a lazy
DataFrame over the whole source table, so the work grows with the data; the
same rules are written as DuckDB SQL in :mod:`jobmix.plans.oracle`.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmix import schemas
from jobmix.sources.tables import Tables

# Fixed values of the fixture rules (they must match the oracle SQL exactly).
# Workspace name tokens, indexed by s_suppkey % 8 and (s_suppkey * 3) % 10.
BU_TOKENS = ["ingest", "daas", "market", "retail", "legacy", "risk", "RISK", "misc"]
ENV_TOKENS = ["dev", "sandbox", "test", "nonprod", "qat", "ppe", "prod", "beta", "prod", "lab"]
# Suppliers with s_suppkey % 17 == 16 get no workspace row.
MISSING_WORKSPACE_MOD = 17
# Job ids are l_partkey % 40; job 39 has no name; jobs below 5 get a second name.
JOB_MOD = 40
NAMELESS_JOB = 39
SECOND_NAME_BELOW = 5
# Cluster ids are c{l_partkey % 20}; c7 has no cluster row.
CLUSTER_MOD = 20
CLUSTER_WITHOUT_ROW = 7
# cluster_source by (l_partkey % 20) % 10: 0 UI, 1 API, 2 PIPELINE, else JOB.
# Prices: SKUs below 7, years from 1996, price = linenumber * 0.05 + (year - 1996) * 0.01,
# the 2001 price stays open.
PRICED_SKU_BELOW = 7
FIRST_PRICED_YEAR = 1996
OPEN_PRICE_YEAR = 2001
PRICE_PER_LINE = Decimal("0.05")
PRICE_PER_YEAR = Decimal("0.01")
# With times of day, a run starts (l_orderkey * 7919 + l_linenumber * 104729) % 86400 seconds after midnight.
SECONDS_PER_ORDER, SECONDS_PER_LINE = 7919, 104729


def _pick(tokens: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in tokens]), index.cast("int") + 1)


def _entry(kind: str, cluster: Column | None) -> Column:
    return F.struct(F.lit(kind).alias("type"),
                    (cluster if cluster is not None else F.lit(None).cast("string")).alias("cluster_id"))


def workspaces(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.concat(F.lit("w-"), _pick(BU_TOKENS, k % 8), F.lit("-"),
                    _pick(ENV_TOKENS, (k * 3) % 10), F.lit("-r1"))
    return (supplier
            .where(k % MISSING_WORKSPACE_MOD != MISSING_WORKSPACE_MOD - 1)
            .select(k.cast("string").alias("workspace_id"), name.alias("workspace_name")))


def _cluster_id() -> Column:
    return F.concat(F.lit("c"), (F.col("l_partkey") % CLUSTER_MOD).cast("string"))


def _time_of_day() -> Column:
    """Seconds after midnight, spread over the day."""
    return (F.col("l_orderkey") * SECONDS_PER_ORDER + F.col("l_linenumber") * SECONDS_PER_LINE) % 86400


def runs(lineitem: DataFrame, times: bool = False) -> DataFrame:
    """The timeline; runs start at midnight of their day, or with ``times`` at any second of it."""
    ok, pk, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    job = pk % JOB_MOD
    srv = _entry("SERVERLESS_COMPUTE", None)
    classic = _entry("CLASSIC_COMPUTE", _cluster_id())
    compute = (F.when(ok % 13 == 0, F.array().cast(schemas.RUN_TIMELINE["compute"].dataType))
               .when(ok % 11 == 0, F.array(_entry("OTHER_COMPUTE", None)))
               .when((job % 4 == 0) | (sk % 5 == 0), F.array(srv))
               .when((job % 4 == 1) & (ok % 2 == 0), F.array(srv, classic))
               .otherwise(F.array(classic)))
    duration = F.when(F.col("l_linenumber") == 7, F.lit(None).cast("bigint")) \
        .otherwise(F.col("l_quantity").cast("bigint") * 30)
    start = F.col("l_shipdate").cast("timestamp")
    if times:
        start = start + F.make_dt_interval(secs=_time_of_day())
    return lineitem.select(
        sk.cast("string").alias("workspace_id"),
        job.cast("string").alias("job_id"),
        ok.cast("string").alias("job_run_id"),
        start.alias("period_start_time"),
        duration.alias("execution_duration_seconds"),
        compute.alias("compute"),
    )


def clusters(lineitem: DataFrame) -> DataFrame:
    """Distinct (workspace, cluster, source).  The distinct runs on the integer
    keys; the id strings are built for the distinct rows only."""
    keys = (lineitem
            .select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % CLUSTER_MOD).alias("c"))
            .where(F.col("c") != CLUSTER_WITHOUT_ROW)
            .distinct())
    c = F.col("c")
    source = (F.when(c % 10 == 0, "UI").when(c % 10 == 1, "API")
              .when(c % 10 == 2, "PIPELINE").otherwise("JOB"))
    return keys.select(F.col("s").cast("string").alias("workspace_id"),
                       F.concat(F.lit("c"), c.cast("string")).alias("cluster_id"),
                       source.alias("cluster_source"))


def jobs(lineitem: DataFrame) -> DataFrame:
    """Distinct (workspace, job, name): the regular name for every job but the
    nameless one, plus an old name for low job ids.  The distinct runs on the
    integer keys, names are built for the distinct rows only; the two name
    kinds never coincide, so their union stays distinct."""
    keys = lineitem.select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % JOB_MOD).alias("j")).distinct()
    ws, job = F.col("s").cast("string").alias("workspace_id"), F.col("j").cast("string").alias("job_id")
    regular = keys.where(F.col("j") != NAMELESS_JOB).select(
        ws, job, F.concat(F.lit("job_"), (F.col("s") % 7).cast("string"), F.lit("_"),
                          F.col("j").cast("string")).alias("name"))
    old = keys.where(F.col("j") < SECOND_NAME_BELOW).select(
        ws, job, F.concat(F.lit("a_old_"), F.col("j").cast("string")).alias("name"))
    return regular.unionByName(old)


def usage(lineitem: DataFrame) -> DataFrame:
    ok = F.col("l_orderkey")
    product = (F.when(F.col("l_returnflag") == "A", "ALL_PURPOSE")
               .when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "SQL")
               .otherwise("JOBS"))
    is_serverless = F.when(ok % 17 == 0, F.lit(None).cast("boolean")) \
        .otherwise(F.col("l_linestatus") == "O")
    job_id = F.when(ok % 19 == 0, F.lit(None).cast("string")) \
        .otherwise((F.col("l_partkey") % JOB_MOD).cast("string"))
    tags = F.when(ok % 3 == 0,
                  F.create_map(F.lit("bu"), F.concat(F.lit("tag_"), (F.col("l_suppkey") % 4).cast("string")))) \
        .otherwise(F.create_map().cast("map<string,string>"))
    return lineitem.select(
        F.to_date("l_shipdate").alias("usage_date"),
        (F.col("l_shipdate").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("usage_end_time"),
        F.col("l_suppkey").cast("string").alias("workspace_id"),
        F.concat(F.lit("SKU_"), F.col("l_linenumber").cast("string")).alias("sku_name"),
        F.lit("DBU").alias("usage_unit"),
        F.col("l_quantity").cast("decimal(18,3)").alias("usage_quantity"),
        product.alias("billing_origin_product"),
        F.struct(is_serverless.alias("is_serverless")).alias("product_features"),
        F.struct(job_id.alias("job_id")).alias("usage_metadata"),
        tags.alias("custom_tags"),
    )


def prices(lineitem: DataFrame) -> DataFrame:
    year = F.year("l_shipdate")
    keys = (lineitem
            .where((F.col("l_linenumber") < PRICED_SKU_BELOW) & (year >= FIRST_PRICED_YEAR))
            .select(F.col("l_linenumber").alias("line"), year.alias("year"))
            .distinct())
    start = F.make_timestamp(F.col("year"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    end = F.make_timestamp(F.col("year") + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    price = (F.col("line").cast("decimal(10,0)") * F.lit(PRICE_PER_LINE)
             + (F.col("year") - FIRST_PRICED_YEAR).cast("decimal(10,0)") * F.lit(PRICE_PER_YEAR))
    return keys.select(
        F.concat(F.lit("SKU_"), F.col("line").cast("string")).alias("sku_name"),
        F.lit("DBU").alias("usage_unit"),
        start.alias("price_start_time"),
        F.when(F.col("year") == OPEN_PRICE_YEAR, F.lit(None).cast("timestamp")).otherwise(end)
        .alias("price_end_time"),
        F.struct(price.cast("decimal(18,6)").alias("default")).alias("pricing"),
    )


def derive_tables(spark: SparkSession, sf_dir: str, times: bool = False) -> Tables:
    """All six inputs from ``<sf_dir>/supplier.parquet`` and ``lineitem.parquet``.

    ``times``: runs start at any time of their day instead of midnight.
    """
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return Tables(
        workspaces=workspaces(supplier),
        runs=runs(lineitem, times),
        clusters=clusters(lineitem),
        jobs=jobs(lineitem),
        usage=usage(lineitem),
        prices=prices(lineitem),
    )
