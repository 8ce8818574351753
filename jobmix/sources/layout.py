"""Date-partitioned storage of the two large inputs.

The run timeline and the usage table grow with time and every report reads a
date range of them, so they are stored partitioned by day: the timeline by
:data:`~jobmix.operators.runs.RUN_DAY` (the UTC day of ``period_start_time``,
the same whatever the writer's time zone), usage by its own ``usage_date``.
The reports' range predicates then prune whole directories.  The four
dimension tables are small and stored as is.

Rows are rebalanced by day before they are written: adaptive execution merges
quiet days into one task and splits a busy day over several, so the files of
a day follow its size and not the number of writing tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmix.operators.runs import RUN_DAY, utc_day
from jobmix.sources.tables import Tables

PARTITION_COLUMNS = {"runs": RUN_DAY, "usage": "usage_date"}


def with_run_day(runs: DataFrame) -> DataFrame:
    return runs.withColumn(RUN_DAY, utc_day())


def write_tables(tables: Tables, root: str, mode: str = "errorifexists", by_day: bool = True,
                 files: int | None = None, max_records_per_file: int = 5_000_000) -> None:
    """Write the six inputs under ``root/<name>`` (a shared filesystem path).

    ``by_day`` partitions the timeline and usage by day (the layout for large
    histories).  Without it, ``files`` spreads each of the two large tables
    over that many files (round-robin), for small data where daily
    directories would only make tiny files.
    """
    for name in ("workspaces", "runs", "clusters", "jobs", "usage", "prices"):
        df = getattr(tables, name)
        if name == "runs" and by_day:
            df = with_run_day(df)
        if name in PARTITION_COLUMNS and not by_day and files:
            df = df.repartition(files)
        part = PARTITION_COLUMNS.get(name) if by_day else None
        if part:
            df = df.hint("rebalance", part)
        writer = df.write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
        if part:
            writer = writer.partitionBy(part)
        writer.parquet(f"{root}/{name}")


#: The run timeline's bucket column: part of the keys of every classification, by workspace and job or by week and job.
JOB_KEY = "job_id"


def bucket_skew(runs: DataFrame, buckets: int) -> float:
    """Rows of the largest bucket over the mean (0 for an empty table)."""
    bucket = F.pmod(F.hash(JOB_KEY), F.lit(buckets)).alias("bucket")
    top, total = runs.groupBy(bucket).count().agg(F.max("count"), F.sum("count")).first()
    return top * buckets / total if total else 0.0


def write_bucketed(tables: Tables, database: str, buckets: int, by_day: bool = True, max_skew: float = 4.0,
                   mode: str = "errorifexists") -> dict[str, str]:
    """Save the six inputs as tables of ``database``, the timeline bucketed by job.

    Classifications per job (and week) over the timeline then need no
    exchange for their first, largest aggregate.  Returns the names that
    :meth:`Tables.from_catalog` takes.

    One task reads one bucket, and nothing splits it further.  So the skew is
    measured first: where the largest bucket has more than ``max_skew`` times
    the mean (a job with a third of all rows, say), a ``ValueError`` tells to
    store by day alone (:func:`write_tables`), whose scans split anywhere.
    With ``by_day`` every bucket also has a file a day, so the range still
    prunes; rows are dealt by the bucket's hash, one writing task a bucket.
    """
    skew = bucket_skew(tables.runs, buckets)
    if skew > max_skew:
        raise ValueError(f"the largest of {buckets} buckets has {skew:.1f} times the mean rows (at most {max_skew}): "
                         "store by day instead")
    names = {}
    for name in ("workspaces", "runs", "clusters", "jobs", "usage", "prices"):
        df = getattr(tables, name)
        part = PARTITION_COLUMNS.get(name) if by_day else None
        if name == "runs" and by_day:
            df = with_run_day(df)
        if name == "runs":
            df = df.repartition(buckets, JOB_KEY)
        elif part:
            df = df.hint("rebalance", part)
        writer = df.write.mode(mode).format("parquet")
        if part:
            writer = writer.partitionBy(part)
        if name == "runs":
            writer = writer.bucketBy(buckets, JOB_KEY)
        names[name] = f"{database}.{name}"
        writer.saveAsTable(names[name])
    return names
