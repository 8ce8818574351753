"""Registered queries: one per result table and one per operator check.

Each Spark query takes ``(spark, sf_dir)``, derives the six telemetry tables
from the whole ``supplier`` / ``lineitem`` tables there and returns a lazy
DataFrame.  :func:`oracle_sql` gives the matching DuckDB SQL with the same
column names and types.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmix.functions.exprs import money
from jobmix.functions.rules import FIXTURE_BU_RULES, contains, one_of
from jobmix.operators import runs as R
from jobmix.operators import spend as S
from jobmix.operators.labels import label_from_tag
from jobmix.params import Params, TimeRange
from jobmix.plans import oracle as O
from jobmix.plans import reports as D
from jobmix.sources.fixtures import derive_tables

# The whole span of the test data (ship dates 1995-01-02 .. 2001-11-04).
FULL_RANGE = TimeRange(dt.date(1995, 1, 1), dt.date(2001, 12, 31))
DEFAULT = Params(FULL_RANGE)
# One BU and one environment, to exercise the filter path.
FILTERED = Params(FULL_RANGE, bu=("Risk",), env=("PROD",))
# Inside the data, so that both ends of the range cut rows off.
MID = Params(TimeRange(dt.date(1996, 3, 15), dt.date(1998, 8, 20)))
# A few days: some business units then have mostly or hardly any serverless jobs.
DAYS = Params(TimeRange(dt.date(1997, 5, 5), dt.date(1997, 5, 6)))
# Several choices at once, and one that names the unlabelled workspaces.
SEVERAL = Params(MID.time_range, bu=("Risk", "Market", "Unmapped"), env=("PROD", "DEV"))
CUSTOM_BU_RULES = (one_of("Special", "w-risk-prod-r1", "w-daas-dev-r1"), contains("Money", "RISK", "market"),
                   contains("Data", "-daas-", "ingest"))
CUSTOM_BU_RULES_SQL = (("Special", None, ("w-risk-prod-r1", "w-daas-dev-r1")), ("Money", "risk", ()),
                       ("Money", "market", ()), ("Data", "-daas-", ()), ("Data", "ingest", ()))
# A range before any data: global aggregates over nothing.
EMPTY = Params(TimeRange(dt.date(1990, 1, 1), dt.date(1990, 12, 31)))
EFFECTIVE_RATE = "0.85"
TAG_KEY = "bu"


def inputs(spark: SparkSession, sf_dir: str) -> D.Inputs:
    return D.Inputs(derive_tables(spark, sf_dir), FIXTURE_BU_RULES)


def inputs_with(spark: SparkSession, sf_dir: str, **changes) -> D.Inputs:
    return replace(inputs(spark, sf_dir), **changes)


def timed_inputs(spark: SparkSession, sf_dir: str) -> D.Inputs:
    """Inputs whose runs start at any time of day: day and week cuts then tell."""
    return D.Inputs(derive_tables(spark, sf_dir, times=True), FIXTURE_BU_RULES)


def _timed(fn, params: Params) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(timed_inputs(spark, sf_dir), params)


def op_ordered(name: str, ties: tuple[str, ...] = ()) -> Callable[[SparkSession, str], DataFrame]:
    """A sorted report with each row's place in it, as the rows come out.

    ``ties``: columns whose equals may come in any order; they get their first place.
    """
    def q(spark, sf_dir):
        out = D.DATASETS[name](inputs(spark, sf_dir), DEFAULT).withColumn("_at", F.monotonically_increasing_id())
        place = F.row_number().over(Window.orderBy("_at"))  # a report: a few hundred rows
        out = out.withColumn("position", place).drop("_at")
        if ties:
            out = out.withColumn("position", F.min("position").over(Window.partitionBy(*ties)))
        return out.withColumn("position", F.col("position").cast("bigint"))
    return q


def _dataset(fn, params: Params = DEFAULT, **changes) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(inputs_with(spark, sf_dir, **changes), params)


# ---------------------------------------------------------------------------
# Operator checks (Spark side)
# ---------------------------------------------------------------------------

def op_label_rules(spark, sf_dir):
    return inputs(spark, sf_dir).ws()


def op_label_from_tag(spark, sf_dir):
    t = inputs(spark, sf_dir).tables
    priced = S.price_usage(t.usage, t.prices, DEFAULT.time_range, keep=["custom_tags"])
    tagged = label_from_tag(priced, TAG_KEY, out="bu")
    b, rev = F.col("bucket"), F.col("revenue")
    return tagged.groupBy("bu").agg(
        money(F.sum(F.when(b == F.lit(S.SRV), rev))).alias("serverless_spend"),
        money(F.sum(F.when(b == F.lit(S.JC), rev))).alias("classic_jobs_spend"),
        money(F.sum(F.when(b == F.lit(S.AP_TOTAL), rev))).alias("all_purpose_total_spend"))


def op_explode_runs(spark, sf_dir):
    t = inputs(spark, sf_dir).tables
    e = R.explode_runs(t.runs, DEFAULT.time_range)
    return e.select("workspace_id", "job_id", "job_run_id",
                    F.to_date("period_start_time").alias("start_date"), "compute_type", "cluster_id")


def op_bucket_runs(spark, sf_dir):
    t = inputs(spark, sf_dir).tables
    e = R.explode_runs(t.runs, DEFAULT.time_range, ("workspace_id", "job_id", "job_run_id"))
    b = R.bucket_runs(e, t.clusters)
    return b.groupBy("workspace_id", "job_id", "bucket").agg(F.sum("weight").alias("entries"))


def _op_tag_runs(params: Params):
    def q(spark, sf_dir):
        inp = inputs(spark, sf_dir)
        e = R.keep_job_compute(R.explode_runs(inp.tables.runs, params.time_range,
                                              ("workspace_id", "job_id")))
        tagged = R.tag_runs(e, inp.ws(), params)
        return tagged.groupBy("workspace_id", "workspace_name", "bu", "env") \
            .agg(F.count(F.lit(1)).alias("entries"))
    return q


def op_classify_jobs(spark, sf_dir):
    return inputs(spark, sf_dir).classified(DEFAULT)


def op_classify_jobs_weekly(spark, sf_dir):
    inp = inputs(spark, sf_dir)
    return R.classified_jobs_weekly(inp.tables.runs, inp.kinds(), inp.ws(), DEFAULT)


def op_job_week_flags(spark, sf_dir):
    inp = inputs(spark, sf_dir)
    return R.job_week_flags(inp.tables.runs, inp.kinds(), inp.ws(), DEFAULT.time_range)


def op_classify_flags_filtered(spark, sf_dir):
    """Per-job classification as a dashboard refresh computes it (from the flags)."""
    inp = inputs(spark, sf_dir)
    flags = R.job_week_flags(inp.tables.runs, inp.kinds(), inp.ws(), FILTERED.time_range)
    return R.classify_flags(flags, R.JOB_KEYS, FILTERED)


def op_price_usage(spark, sf_dir):
    t = inputs(spark, sf_dir).tables
    priced = S.price_usage(t.usage, t.prices, DEFAULT.time_range)
    return priced.select("date", "workspace_id", "bucket", F.col("revenue").cast("double").alias("revenue"))


def op_price_usage_rate(spark, sf_dir):
    t = inputs(spark, sf_dir).tables
    priced = S.price_usage(t.usage, t.prices, DEFAULT.time_range, rate=EFFECTIVE_RATE)
    return priced.groupBy("bucket").agg(F.count(F.lit(1)).alias("usage_rows"),
                                        money(F.sum("revenue")).alias("spend"))


def op_spend_by_bu(spark, sf_dir):
    inp = inputs(spark, sf_dir)
    t = inp.tables
    tagged = S.tag_spend(S.price_usage(t.usage, t.prices, DEFAULT.time_range), inp.ws(), DEFAULT)
    b, rev = F.col("bucket"), F.col("revenue")
    return tagged.groupBy("bu").agg(
        money(F.sum(F.when(b == F.lit(S.SRV), rev))).alias("serverless_spend"),
        money(F.sum(F.when(b == F.lit(S.JC), rev))).alias("classic_jobs_spend"),
        money(F.sum(F.when(b == F.lit(S.AP_TOTAL), rev))).alias("all_purpose_total_spend"))


def op_serverless_usage(spark, sf_dir):
    t = inputs(spark, sf_dir).tables
    s = S.serverless_usage(t.usage, DEFAULT.time_range)
    return s.select("workspace_id", "job_id", money("serverless_dbus", 3).alias("serverless_dbus"),
                    "first_usage", "last_usage")


# ---------------------------------------------------------------------------
# Registry
# ---------------------------------------------------------------------------

def _entries():
    """key -> (spark query, oracle SQL or None)."""
    out = {name: (_dataset(fn), getattr(O, name)(DEFAULT)) for name, fn in D.DATASETS.items()}
    out.update({
        "op_label_rules": (op_label_rules, O.op_label_rules()),
        "op_label_from_tag": (op_label_from_tag, O.op_label_from_tag(DEFAULT)),
        "op_explode_runs": (op_explode_runs, O.op_explode_runs(DEFAULT)),
        "op_bucket_runs": (op_bucket_runs, O.op_bucket_runs(DEFAULT)),
        "op_tag_runs_filtered": (_op_tag_runs(FILTERED), O.op_tag_runs(FILTERED)),
        "op_tag_runs_all": (_op_tag_runs(DEFAULT), O.op_tag_runs(DEFAULT)),
        "op_classify_jobs": (op_classify_jobs, O.op_classify_jobs(DEFAULT)),
        "op_classify_jobs_weekly": (op_classify_jobs_weekly, O.op_classify_jobs_weekly(DEFAULT)),
        "op_job_week_flags": (op_job_week_flags, O.op_job_week_flags(DEFAULT)),
        "op_classify_flags_filtered": (op_classify_flags_filtered, O.op_classify_jobs(FILTERED)),
        "op_price_usage": (op_price_usage, O.op_price_usage(DEFAULT)),
        "op_price_usage_rate": (op_price_usage_rate, O.op_price_usage_rate(DEFAULT, EFFECTIVE_RATE)),
        "op_spend_by_bu": (op_spend_by_bu, O.op_spend_by_bu(DEFAULT)),
        "op_serverless_usage": (op_serverless_usage, O.op_serverless_usage(DEFAULT)),
        "op_safe_pct_empty": (_dataset(D.kpi_headline, EMPTY), O.kpi_headline(EMPTY)),
        "kpi_headline_filtered": (_dataset(D.kpi_headline, FILTERED), O.kpi_headline(FILTERED)),
        "spend_kpi_filtered": (_dataset(D.spend_kpi, FILTERED), O.spend_kpi(FILTERED)),
        "job_table_filtered": (_dataset(D.job_table, FILTERED), O.job_table(FILTERED)),
        "op_custom_rules": (lambda spark, sf_dir: inputs_with(spark, sf_dir, bu_rules=CUSTOM_BU_RULES).ws(),
                            O.op_custom_rules(CUSTOM_BU_RULES_SQL)),
        "spend_kpi_rate": (_dataset(D.spend_kpi, MID, rate=EFFECTIVE_RATE), O.spend_kpi(MID, rate=EFFECTIVE_RATE)),
        "spend_kpi_tag": (_dataset(D.spend_kpi, MID.with_(bu=("tag_1", "Unmapped")), bu_tag=TAG_KEY),
                          O.spend_kpi(MID.with_(bu=("tag_1", "Unmapped")), tag=True)),
        "serverless_job_table_tag": (_dataset(D.serverless_job_table, MID.with_(bu=("tag_2",)), bu_tag=TAG_KEY),
                                     O.serverless_job_table(MID.with_(bu=("tag_2",)), tag=True)),
        "bu_opportunities_days": (_dataset(D.bu_opportunities, DAYS), O.bu_opportunities(DAYS)),
    })
    for name in ("kpi_headline", "spend_kpi", "time_series_counts", "job_table", "serverless_job_table"):
        out[f"{name}_midrange"] = (_dataset(D.DATASETS[name], MID), getattr(O, name)(MID))
    # bu_trend ignores the environment choice; the others apply both.
    for name in ("breakdown_by_bu", "breakdown_by_env", "bu_heatmap", "env_heatmap", "bu_scorecard", "env_kpi",
                 "bu_opportunities", "bu_trend", "time_series_counts", "time_series_pct", "serverless_job_table"):
        out[f"{name}_several"] = (_dataset(D.DATASETS[name], SEVERAL), getattr(O, name)(SEVERAL))
    for name in ("kpi_headline", "time_series_counts", "bu_trend", "job_table"):
        out[f"{name}_times"] = (_timed(D.DATASETS[name], MID), getattr(O, name)(MID, O.timed_tables()))
    for name in O.ORDERS:
        out[f"op_ordered_{name}"] = (op_ordered(name, ("bu",) if name == "breakdown_by_bu" else ()),
                                     O.op_ordered(name, DEFAULT))
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _entries().items() if v[1] is not None}
