"""The 16 result tables of the migration dashboard.

Every function has the signature ``name(inputs, params) -> DataFrame``; the
DataFrames are lazy, so a caller can ``explain()``, ``write`` or ``collect``
them.  Percentages and money come out as doubles, rounded half-up in decimal.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmix.functions.exprs import cond_count, flag, money, pct
from jobmix.functions.rules import ENV_RULES, Rule
from jobmix.operators import runs as R
from jobmix.operators import spend as S
from jobmix.operators.joins import dimension_join
from jobmix.operators.labels import attach_labels, label_from_tag, workspace_labels
from jobmix.operators.summary import adoption_summary, bucket_label, is_bucket
from jobmix.params import ALL, UNMAPPED, Params
from jobmix.sources.tables import Tables

TOP_K = 500  # row cap of the two per-job lists (a top-k report by design)


@dataclass(frozen=True)
class Inputs:
    """The six tables and how workspaces get their labels.

    ``bu_rules`` maps workspace names to business units and depends on the
    estate's naming convention, so there is no default.  With ``bu_tag`` the
    usage-based tables (spend, serverless list) take the business unit from
    that tag of the usage instead.  ``rate`` multiplies list prices.
    """

    tables: Tables
    bu_rules: Sequence[Rule]
    env_rules: Sequence[Rule] = field(default=ENV_RULES)
    bu_tag: str | None = None
    rate: Decimal | str = Decimal("1.0")

    def __post_init__(self):
        if not self.bu_rules and not self.bu_tag:
            raise ValueError("no business-unit rules: pass bu_rules (or load them with load_rules), or a bu_tag")

    @property
    def spark(self) -> SparkSession:
        return self.tables.runs.sparkSession

    def ws(self) -> DataFrame:
        """The labelled workspace dimension."""
        return workspace_labels(self.tables.workspaces, self.bu_rules, self.env_rules)

    def kinds(self) -> DataFrame:
        """The cluster table, collapsed."""
        return R.cluster_kinds(self.tables.clusters)

    def classified(self, params: Params) -> DataFrame:
        """One row per (workspace_id, bu, env, job_id) with ``primary_bucket``."""
        return R.classified_jobs(self.tables.runs, self.kinds(), self.ws(), params)

    def weekly(self, params: Params, keys: Sequence[str] = ("week", "job_id"),
               use_env: bool = True, drop_unmapped_bu: bool = False) -> DataFrame:
        """One row per (week, ..., job_id) with ``primary_bucket``."""
        return R.classified_jobs_weekly(self.tables.runs, self.kinds(), self.ws(), params,
                                        keys=keys, use_env=use_env,
                                        drop_unmapped_bu=drop_unmapped_bu)


# --------------------------------------------------------------------------
# Job classification family
# --------------------------------------------------------------------------

def kpi_headline(inp: Inputs, p: Params) -> DataFrame:
    """One row of account-level job counts and shares (Unmapped included)."""
    return adoption_summary(
        inp.classified(p),
        names={"total_jobs": "*", "jobs_all_purpose": R.AP, "jobs_classic": R.JC,
               "jobs_serverless": R.SRV},
        pcts={"pct_serverless": R.SRV, "pct_all_purpose": R.AP, "pct_classic": R.JC})


def _breakdown(classified: DataFrame, dim: str) -> DataFrame:
    return (classified.groupBy(dim, "primary_bucket").agg(F.count(F.lit(1)).alias("jobs"))
            .select(dim, bucket_label().alias("compute_type"), "jobs"))


def breakdown_by_bu(inp: Inputs, p: Params) -> DataFrame:
    """D3: jobs per (bu, compute type), Unmapped excluded."""
    c = inp.classified(p).where(F.col("bu") != F.lit(UNMAPPED))
    return _breakdown(c, "bu").orderBy("bu")


def breakdown_by_env(inp: Inputs, p: Params) -> DataFrame:
    """Jobs per (env, compute type), Unmapped kept."""
    return _breakdown(inp.classified(p), "env").orderBy("env")


def _heatmap(classified: DataFrame, dim: str, out: str) -> DataFrame:
    per = _breakdown(classified, dim)
    # Whole-partition window over the small aggregate (a handful of rows per label).
    share = pct(F.col("jobs"), F.sum("jobs").over(Window.partitionBy(dim)))
    return per.select(dim, "compute_type", "jobs", share.alias(out)).orderBy(dim, "compute_type")


def bu_heatmap(inp: Inputs, p: Params) -> DataFrame:
    """D3 plus each cell's share of its BU."""
    c = inp.classified(p).where(F.col("bu") != F.lit(UNMAPPED))
    return _heatmap(c, "bu", "pct_of_bu")


def env_heatmap(inp: Inputs, p: Params) -> DataFrame:
    """D4 plus each cell's share of its environment."""
    return _heatmap(inp.classified(p), "env", "pct_of_env")


def bu_scorecard(inp: Inputs, p: Params) -> DataFrame:
    """Per BU totals and shares, largest first, Unmapped excluded."""
    c = inp.classified(p).where(F.col("bu") != F.lit(UNMAPPED))
    s = adoption_summary(
        c, by=["bu"],
        names={"total_jobs": "*", "serverless_jobs": R.SRV, "all_purpose_jobs": R.AP,
               "jobs_compute_jobs": R.JC},
        pcts={"pct_serverless": R.SRV, "pct_all_purpose": R.AP, "pct_jobs_compute": R.JC})
    return s.select("bu", "total_jobs", "serverless_jobs", "pct_serverless", "all_purpose_jobs",
                    "pct_all_purpose", "jobs_compute_jobs", "pct_jobs_compute") \
        .orderBy(F.desc("total_jobs"), "bu")


def env_kpi(inp: Inputs, p: Params) -> DataFrame:
    """Per environment totals and serverless share, Unmapped kept."""
    s = adoption_summary(
        inp.classified(p), by=["env"],
        names={"total_jobs": "*", "jobs_all_purpose": R.AP, "jobs_classic": R.JC,
               "jobs_serverless": R.SRV},
        pcts={"pct_serverless": R.SRV})
    return s.orderBy("env")


def bu_opportunities(inp: Inputs, p: Params) -> DataFrame:
    """BUs at >= 50 % serverless, BUs under 5 %, and the BU with most AP jobs.

    The thresholds apply to the rounded percentage.  The arg-max breaks ties
    by the alphabetically last BU; it is NULL only when there is no BU.
    One aggregate over the per-BU summary answers all three questions.
    """
    c = inp.classified(p).where(F.col("bu") != F.lit(UNMAPPED))
    per_bu = c.groupBy("bu").agg(
        cond_count(is_bucket(R.AP)).alias("jobs_ap"),
        pct(cond_count(is_bucket(R.SRV)), F.count(F.lit(1))).alias("pct_srv"))
    return per_bu.agg(
        F.count_if(F.col("pct_srv") >= 50).alias("bus_above_50pct"),
        F.count_if(F.col("pct_srv") < 5).alias("bus_below_5pct"),
        F.max_by("bu", F.struct("jobs_ap", "bu")).alias("largest_ap_fleet"))


# --------------------------------------------------------------------------
# Weekly trend family
# --------------------------------------------------------------------------

def bu_trend(inp: Inputs, p: Params) -> DataFrame:
    """Weekly serverless share per BU.  BU filter only; Unmapped excluded."""
    w = inp.weekly(p, keys=("week", "bu", "job_id"), use_env=False, drop_unmapped_bu=True)
    return (w.groupBy("week", "bu")
            .agg(pct(cond_count(is_bucket(R.SRV)), F.count(F.lit(1))).alias("pct_serverless"))
            .orderBy("week", "bu"))


def _weekly(inp: Inputs, p: Params) -> DataFrame:
    return inp.weekly(p, keys=("week", "job_id"))


def time_series_counts(inp: Inputs, p: Params) -> DataFrame:
    """Jobs per week by worst bucket of that week."""
    return (_weekly(inp, p).groupBy("week")
            .agg(cond_count(is_bucket(R.AP)).alias("all_purpose"),
                 cond_count(is_bucket(R.JC)).alias("jobs_compute"),
                 cond_count(is_bucket(R.SRV)).alias("serverless"))
            .orderBy("week"))


def time_series_pct(inp: Inputs, p: Params) -> DataFrame:
    """Jobs per week and the serverless share."""
    return (_weekly(inp, p).groupBy("week")
            .agg(F.count(F.lit(1)).alias("total_jobs"),
                 pct(cond_count(is_bucket(R.SRV)), F.count(F.lit(1))).alias("pct_serverless"))
            .orderBy("week"))


# --------------------------------------------------------------------------
# Spend and per-job lists
# --------------------------------------------------------------------------

def spend_kpi(inp: Inputs, p: Params, rate: Decimal | str | None = None) -> DataFrame:
    """Serverless jobs, classic jobs and all-purpose spend (list price x rate)."""
    priced = S.price_usage(inp.tables.usage, inp.tables.prices, p.time_range,
                           rate=inp.rate if rate is None else rate,
                           keep=("custom_tags",) if inp.bu_tag else ())
    if inp.bu_tag:
        priced = label_from_tag(priced, inp.bu_tag).drop("custom_tags")
    tagged = S.tag_spend(priced, inp.ws(), p)
    b, rev = F.col("bucket"), F.col("revenue")
    return tagged.agg(
        money(F.sum(F.when(b == F.lit(S.SRV), rev))).alias("serverless_spend"),
        money(F.sum(F.when(b == F.lit(S.JC), rev))).alias("classic_jobs_spend"),
        money(F.sum(F.when(b == F.lit(S.AP_TOTAL), rev))).alias("all_purpose_total_spend"))


GROUP = ("workspace_name", "bu", "env", "job_id")
# Days in a word of a day bitmap.
WORD = 64


def job_table(inp: Inputs, p: Params, limit: int = TOP_K) -> DataFrame:
    """The backlog -- jobs with classic entries, by number of runs.

    Grouped by workspace *name* (workspaces sharing a name are one row).
    Serverless entries of a mixed job are not counted.  The average runtime
    weighs each entry by the number of cluster and job-name rows it matches,
    exactly as a fan-out join would, without materialising the fan-out.

    One pass over the timeline.  Every classic entry ends up as AP or JC, so
    the number of runs and of days needs no lookup.  An entry stands for its
    run, for its cluster, and for its day, a bit in one of the words of the
    group's day bitmap; all are reduced before anything moves, to the distinct
    runs, to a row per cluster (sums, last day), and to a number per word, one
    for each 64 days of the range.  Runs and bits are then counted; only rows per
    cluster meet the cluster table, only rows per workspace and job the names.
    No buffer grows with the runs, clusters or days of a job.
    """
    t, ws = inp.tables, inp.ws()
    entries = R.tag_runs(R.keep_job_compute(
        R.explode_runs(t.runs, p.time_range,
                       ("workspace_id", "job_id", "job_run_id", "period_start_time",
                        "execution_duration_seconds")),
        types=(R.CLASSIC,)), ws, p)
    day = F.to_date("period_start_time")
    offset = F.date_diff(day, F.lit(p.time_range.min))
    fields = {"workspace_id": ("string", F.col("workspace_id")), "cluster_id": ("string", F.col("cluster_id")),
              "job_run_id": ("string", F.col("job_run_id")), "word": ("int", F.shiftright(offset, 6)),
              "compute_type": ("string", F.col("compute_type")),
              "seconds": ("bigint", F.col("execution_duration_seconds")), "day": ("date", day),
              "bits": ("bigint", F.call_function("shiftleft", F.lit(1).cast("bigint"), offset.bitwiseAND(F.lit(WORD - 1))))}

    def stands_for(*kept: str):
        return F.struct(*[(c if name in kept else F.lit(None)).cast(kind).alias(name)
                          for name, (kind, c) in fields.items()])

    rows = entries.select(*GROUP, F.inline(F.array(
        stands_for("job_run_id"), stands_for("word", "bits"),
        stands_for("workspace_id", "cluster_id", "compute_type", "seconds", "day"))))
    cluster = (*GROUP, "workspace_id", "cluster_id", "compute_type")
    reduced = rows.groupBy(*cluster, "job_run_id", "word").agg(
        F.sum("seconds").alias("seconds"), F.count("seconds").alias("known"), F.max("day").alias("last_day"),
        F.bit_or("bits").alias("bits"))
    per_cluster = reduced.groupBy(*cluster).agg(
        F.sum("seconds").alias("seconds"), F.sum("known").alias("known"), F.max("last_day").alias("last_day"),
        F.count("job_run_id").alias("run_count"), F.sum(F.bit_count("bits")).alias("active_days"))

    w = F.col("weight")
    # A cluster with rows of both kinds comes twice; runs and days stand in rows without a cluster.
    per_job = R.bucket_runs(per_cluster, inp.kinds()).groupBy(*GROUP, "workspace_id").agg(
        F.sum(F.col("seconds") * w).alias("seconds"), F.sum(F.col("known") * w).alias("known"),
        F.max("last_day").alias("last_day"), flag(F.col("bucket") == F.lit(R.AP)).alias("used_ap"),
        F.sum("run_count").alias("run_count"), F.sum("active_days").alias("active_days"))
    named = dimension_join(per_job, S.job_names(t.jobs), ["workspace_id", "job_id"], "left")
    n = F.coalesce(F.col("name_rows"), F.lit(1))
    seconds = F.try_divide(F.sum(F.col("seconds") * n).cast("double"), F.sum(F.col("known") * n).cast("double"))
    return (named.groupBy(*GROUP).agg(
                F.max("job_name").alias("job_name"),
                F.when(F.max("used_ap") == 1, F.lit("JOBS_ON_ALL_PURPOSE"))
                .otherwise(F.lit("JOBS_ON_CLASSIC")).alias("compute_bucket"),
                F.sum("run_count").alias("run_count"),
                F.sum("active_days").alias("active_days"),
                F.round(seconds / F.lit(60.0), 1).alias("avg_runtime_min"),
                F.max("last_day").alias("last_run_date"))
            .orderBy(F.desc("run_count"), F.asc_nulls_first("workspace_name"),
                     F.asc_nulls_first("job_id"))
            .limit(limit))


def serverless_job_table(inp: Inputs, p: Params, limit: int = TOP_K) -> DataFrame:
    """Jobs already on serverless, by DBUs used in range."""
    usage = inp.tables.usage
    if inp.bu_tag:
        srv = S.serverless_usage(label_from_tag(usage, inp.bu_tag), p.time_range, keep=("bu",))
    else:
        srv = S.serverless_usage(usage, p.time_range)
    labelled = attach_labels(srv, inp.ws(), p, keep_bu=bool(inp.bu_tag))
    named = dimension_join(labelled, S.job_names(inp.tables.jobs), ["workspace_id", "job_id"], "left")
    # Rows equal on every grouped column (workspaces sharing a name) collapse.
    grouped = named.groupBy("bu", "env", "workspace_name", "job_id", "serverless_dbus",
                            "first_usage", "last_usage").agg(F.max("job_name").alias("job_name"))
    out = grouped.select("bu", "env", "workspace_name", "job_id", "job_name",
                         money("serverless_dbus").alias("serverless_dbus"),
                         "first_usage", "last_usage")
    return out.orderBy(F.desc("serverless_dbus"), F.asc_nulls_first("workspace_name"),
                       F.asc_nulls_first("job_id"), F.asc_nulls_first("first_usage"),
                       F.asc_nulls_first("last_usage")).limit(limit)


# --------------------------------------------------------------------------
# Filter choices
# --------------------------------------------------------------------------

def _choices(inp: Inputs, dim: str, drop_unmapped: bool) -> DataFrame:
    ws = inp.ws().select(dim)
    if drop_unmapped:
        ws = ws.where(F.col(dim) != F.lit(UNMAPPED))
    all_row = inp.spark.range(1).select(F.lit(ALL).alias(dim))
    return all_row.union(ws).distinct().orderBy(dim)


def param_bu(inp: Inputs, p: Params | None = None) -> DataFrame:
    """``All`` and every BU (not Unmapped)."""
    return _choices(inp, "bu", drop_unmapped=True)


def param_env(inp: Inputs, p: Params | None = None) -> DataFrame:
    """``All`` and every environment (Unmapped included)."""
    return _choices(inp, "env", drop_unmapped=False)


DATASETS = {
    "kpi_headline": kpi_headline,
    "spend_kpi": spend_kpi,
    "breakdown_by_bu": breakdown_by_bu,
    "breakdown_by_env": breakdown_by_env,
    "bu_heatmap": bu_heatmap,
    "env_heatmap": env_heatmap,
    "bu_scorecard": bu_scorecard,
    "env_kpi": env_kpi,
    "bu_opportunities": bu_opportunities,
    "bu_trend": bu_trend,
    "time_series_counts": time_series_counts,
    "time_series_pct": time_series_pct,
    "job_table": job_table,
    "serverless_job_table": serverless_job_table,
    "param_bu": param_bu,
    "param_env": param_env,
}
