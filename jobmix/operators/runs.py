"""From the task-run timeline to one classification per job.

Steps (each a DataFrame -> DataFrame function):

1. :func:`explode_runs`  -- runs started in the date range, one row per compute entry
2. :func:`keep_job_compute` -- drop entries that are neither serverless nor classic
3. :func:`tag_runs`      -- attach workspace labels and apply the BU / env filters
4. :func:`bucket_runs`   -- SRV / AP / JC per entry, via the cluster's source
5. :func:`classify_jobs` -- worst bucket a job used: AP over JC over SRV

Tagging runs before bucketing: both are left joins on keys of the run row
(workspace id; workspace id + cluster id), so their order does not change the
result, and filtering on the labels first shrinks what the cluster join moves.
"""

from __future__ import annotations

import datetime as dt
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmix.functions.exprs import flag, multi_select, week_start
from jobmix.operators.joins import fits_broadcast
from jobmix.operators.labels import attach_labels
from jobmix.params import UNMAPPED, Params, TimeRange

SERVERLESS = "SERVERLESS_COMPUTE"
CLASSIC = "CLASSIC_COMPUTE"

SRV, AP, JC, OTHER = "SRV", "AP", "JC", "OTHER"
# Cluster sources that mean an interactive (all-purpose) cluster.
INTERACTIVE_SOURCES = ("UI", "API")

RUN_COLUMNS = ("workspace_id", "job_id", "job_run_id", "period_start_time")
# Partition column of a timeline stored by day (see jobmix.sources.layout): the UTC day.
RUN_DAY = "run_day_utc"


def utc_day(ts: str = "period_start_time") -> Column:
    """The UTC day of a timestamp, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int"))


def run_window(timeline: DataFrame, time_range: TimeRange) -> DataFrame:
    """Timeline rows with ``min <= period_start_time < max + 1 day``.

    The bounds are literals on the bare column, so the predicate reaches the
    Parquet scan (row-group skipping).  On storage partitioned by the UTC day
    a second predicate prunes directories; it is a day wider on both sides
    than the range, as no time zone is further from UTC, and so drops no row
    that the exact bound keeps.
    """
    ts = F.col("period_start_time")
    lo = F.lit(time_range.min).cast("timestamp")
    hi = F.lit(time_range.end_exclusive).cast("timestamp")
    out = timeline.where((ts >= lo) & (ts < hi))
    if RUN_DAY in timeline.columns:
        day = dt.timedelta(days=1)
        out = out.where(F.col(RUN_DAY).between(F.lit(time_range.min - day), F.lit(time_range.max + day)))
    return out


def explode_runs(timeline: DataFrame, time_range: TimeRange,
                 columns: Sequence[str] = RUN_COLUMNS, week: bool = False) -> DataFrame:
    """One row per compute entry of each run in range (NULL / empty arrays vanish).

    Output: ``columns`` + ``compute_type``, ``cluster_id`` (+ ``week``).
    """
    keep = list(columns)
    need = keep + (["period_start_time"] if week and "period_start_time" not in keep else [])
    exploded = run_window(timeline, time_range).select(*need, F.explode("compute").alias("c"))
    out = exploded.select(*need, F.col("c.type").alias("compute_type"),
                          F.col("c.cluster_id").alias("cluster_id"))
    if week:
        out = out.withColumn("week", week_start("period_start_time"))
        if "period_start_time" not in keep:
            out = out.drop("period_start_time")
    return out


def keep_job_compute(entries: DataFrame, types: Sequence[str] = (SERVERLESS, CLASSIC)) -> DataFrame:
    """Entries of the given compute types (the rest would bucket as OTHER)."""
    return entries.where(F.col("compute_type").isin(list(types)))


def tag_runs(entries: DataFrame, ws: DataFrame, params: Params | None = None,
             use_env: bool = True, drop_unmapped_bu: bool = False) -> DataFrame:
    """Attach ``bu``, ``env``, ``workspace_name`` to run entries and filter on the choices."""
    return attach_labels(entries, ws, params, use_env=use_env, drop_unmapped_bu=drop_unmapped_bu)


def cluster_kinds(clusters: DataFrame) -> DataFrame:
    """Clusters collapsed to one row per (workspace, cluster).

    ``ap_rows`` and ``jc_rows`` count the cluster rows with an interactive
    source and with any other, so however many history rows the cluster table
    keeps, a lookup finds one row that carries the multiplicity a plain
    join would have produced.  A table already collapsed is returned as it is,
    so a refresh collapses its clusters once.
    """
    if "ap_rows" in clusters.columns:
        return clusters
    interactive = F.coalesce(F.col("cluster_source").isin(list(INTERACTIVE_SOURCES)), F.lit(False))
    return (clusters
            .where(F.col("cluster_id").isNotNull())
            .groupBy("workspace_id", "cluster_id")
            .agg(F.count_if(interactive).alias("ap_rows"), F.count_if(~interactive).alias("jc_rows")))


def bucket_runs(entries: DataFrame, clusters: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """Add ``bucket`` (SRV / AP / JC / OTHER) and ``weight`` to each entry.

    Classic entries look up their cluster: an interactive source makes them
    AP, any other source (or no cluster row at all) JC; a cluster with rows of
    both kinds makes an entry two rows.  ``weight`` is the number of rows a
    plain join against the cluster history would have produced for this
    (entry, bucket); it matters only for averages.

    ``broadcast`` (default: decided from the size estimate of the clusters looked
    up) picks the join.  Broadcast: entries stream through a hash lookup, no
    shuffle.  Else both sides are shuffled by cluster and a salt: see
    :func:`_lookup_key` and :func:`salts`.
    """
    kinds = told_kinds(clusters)
    if broadcast is None:
        broadcast = fits_broadcast(kinds)
    classic = F.col("compute_type") == F.lit(CLASSIC)
    rows = F.filter(F.array(F.struct(F.lit(AP).alias("cl_bucket"), F.col("ap_rows").alias("cl_rows")),
                            F.struct(F.lit(JC).alias("cl_bucket"), F.col("jc_rows").alias("cl_rows"))),
                    lambda k: k["cl_rows"] > 0)
    k = kinds.select(F.col("workspace_id").alias("_k_ws"), F.col("cluster_id").alias("_k_cluster"),
                     F.inline(rows))
    if broadcast:
        e = entries.withColumn("_cluster_key", F.col("cluster_id"))
        k = F.broadcast(k)
        same_salt = F.lit(True)
    else:
        n = salts(entries.sparkSession)
        row = F.xxhash64(*[F.col(c) for c in entries.columns])
        e = entries.withColumns({"_cluster_key": _lookup_key(row), "_salt": F.pmod(row, F.lit(n))})
        k = k.withColumn("_k_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
        same_salt = F.col("_salt") == F.col("_k_salt")
    cond = (e["workspace_id"] == k["_k_ws"]) & (e["_cluster_key"] == k["_k_cluster"]) & classic & same_salt
    joined = e.join(k, cond, "left")
    bucket = (F.when(F.col("compute_type") == F.lit(SERVERLESS), F.lit(SRV))
              .when(classic & (F.col("cl_bucket") == F.lit(AP)), F.lit(AP))
              .when(classic, F.lit(JC))
              .otherwise(F.lit(OTHER)))
    return joined.select(*entries.columns, bucket.alias("bucket"),
                         F.coalesce("cl_rows", F.lit(1)).cast("bigint").alias("weight"))


def told_kinds(clusters: DataFrame) -> DataFrame:
    """:func:`cluster_kinds` without the clusters of a single, not interactive row.

    A classic entry without a match is JC with weight 1, which is what such a row
    says; and those are most rows, as a job cluster is usually made for one run.
    """
    return cluster_kinds(clusters).where("ap_rows > 0 OR jc_rows > 1")


# A shuffled lookup replicates its clusters at most this often.
MOST_SALTS = 256


def salts(spark: SparkSession) -> int:
    """Pieces that a shuffled lookup splits every cluster into.

    A third as many as there are shuffle partitions: a cluster with a third
    of all entries then makes pieces of a partition's size.  Adaptive
    execution does not split it, as the clusters are already partitioned
    by their aggregate and not by an exchange of the join's.
    """
    return max(1, min(MOST_SALTS, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)))


def _lookup_key(row: Column) -> Column:
    """Join key for a shuffled lookup of entries with the hash ``row``.

    Only classic entries need the lookup.  The others get a key that cannot
    match (the residual ``classic`` condition guarantees it) and is spread
    by a hash of the row, instead of a NULL key that would send every
    serverless entry of a workspace to one shuffle partition.
    """
    classic = F.col("compute_type") == F.lit(CLASSIC)
    return F.when(classic, F.col("cluster_id")).otherwise(F.concat(F.lit("~"), row.cast("string")))


def _for_classification(tagged: DataFrame, clusters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What classification needs from each entry (``keys`` and ``bucket``), looked up.

    A broadcast lookup streams the entries through, and the flags that follow
    are aggregated map-side: nothing but flags is shuffled.  A lookup that has
    to shuffle moves the distinct (keys, type, cluster) rows instead of the
    entries, reduced map-side first; a cluster that a job used in a million
    runs is one row.
    """
    kinds = classifying_kinds(clusters)
    cluster = F.when(F.col("compute_type") == F.lit(CLASSIC), F.col("cluster_id"))
    cols = list(dict.fromkeys([*keys, "workspace_id"]))
    entries = tagged.select(*cols, "compute_type", cluster.alias("cluster_id"))
    broadcast = fits_broadcast(kinds)
    return bucket_runs(entries if broadcast else entries.distinct(), kinds, broadcast)


def classifying_kinds(clusters: DataFrame) -> DataFrame:
    """:func:`cluster_kinds` of the clusters that were ever interactive.

    A classic entry is JC when its cluster has no row, so rows of clusters that
    are only ever job clusters change no classification; and those are nearly
    all, as a job cluster is usually made for one run.
    """
    return cluster_kinds(clusters).where("ap_rows > 0")


def classify_jobs(bucketed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Worst bucket per job: AP if any entry was AP, else JC if any was JC, else SRV.

    Rows with bucket OTHER are ignored (as if filtered out before).
    """
    b = F.col("bucket")
    per_job = (bucketed.where(b != F.lit(OTHER))
               .groupBy(*keys)
               .agg(flag(b == F.lit(AP)).alias("used_ap"), flag(b == F.lit(JC)).alias("used_jc")))
    primary = (F.when(F.col("used_ap") == 1, F.lit(AP))
               .when(F.col("used_jc") == 1, F.lit(JC))
               .otherwise(F.lit(SRV)))
    return per_job.select(*keys, primary.alias("primary_bucket"))


JOB_KEYS = ("workspace_id", "bu", "env", "job_id")


def classified_jobs(runs: DataFrame, clusters: DataFrame, ws: DataFrame, params: Params,
                    keys: Sequence[str] = JOB_KEYS) -> DataFrame:
    """Runs in range -> one row per job with its ``primary_bucket``."""
    entries = keep_job_compute(explode_runs(runs, params.time_range, ("workspace_id", "job_id")))
    tagged = tag_runs(entries, ws, params)
    return classify_jobs(_for_classification(tagged, clusters, keys), keys)


def classified_jobs_weekly(runs: DataFrame, clusters: DataFrame, ws: DataFrame, params: Params,
                           keys: Sequence[str] = ("week", "job_id"), use_env: bool = True,
                           drop_unmapped_bu: bool = False) -> DataFrame:
    """Runs in range -> one row per (week, ..., job) with its ``primary_bucket``.

    The default key has no workspace id, so equal job ids of different
    workspaces are one job per week (as the weekly dashboard counts them).
    """
    entries = keep_job_compute(explode_runs(runs, params.time_range, ("workspace_id", "job_id"),
                                            week=True))
    tagged = tag_runs(entries, ws, params, use_env=use_env, drop_unmapped_bu=drop_unmapped_bu)
    return classify_jobs(_for_classification(tagged, clusters, keys), keys)


FLAG_KEYS = ("week", "workspace_id", "bu", "env", "job_id")


def job_week_flags(runs: DataFrame, clusters: DataFrame, ws: DataFrame,
                   time_range: TimeRange) -> DataFrame:
    """Per (week, workspace, bu, env, job): did the job use AP / JC compute.

    Unfiltered by BU / env (those are columns, filtered by the consumer), so
    one such table answers every per-job and per-week classification of a
    date range.  Its size is bounded by jobs x weeks, not by runs.
    """
    entries = keep_job_compute(explode_runs(runs, time_range, ("workspace_id", "job_id"), week=True))
    tagged = tag_runs(entries, ws)
    b = F.col("bucket")
    return (_for_classification(tagged, clusters, FLAG_KEYS)
            .where(b != F.lit(OTHER))
            .groupBy(*FLAG_KEYS)
            .agg(flag(b == F.lit(AP)).alias("used_ap"), flag(b == F.lit(JC)).alias("used_jc")))


def classify_flags(flags: DataFrame, keys: Sequence[str], params: Params | None = None,
                   use_env: bool = True, drop_unmapped_bu: bool = False) -> DataFrame:
    """:func:`classify_jobs` over :func:`job_week_flags` rows (same filters, same result)."""
    f = flags
    if drop_unmapped_bu:
        f = f.where(F.col("bu") != UNMAPPED)
    if params is not None:
        f = f.where(multi_select("bu", params.bu))
        if use_env:
            f = f.where(multi_select("env", params.env))
    per_job = f.groupBy(*keys).agg(F.max("used_ap").alias("used_ap"), F.max("used_jc").alias("used_jc"))
    primary = (F.when(F.col("used_ap") == 1, F.lit(AP))
               .when(F.col("used_jc") == 1, F.lit(JC))
               .otherwise(F.lit(SRV)))
    return per_job.select(*keys, primary.alias("primary_bucket"))
