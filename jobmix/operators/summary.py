"""Adoption summaries over classified jobs."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmix.functions.exprs import cond_count, pct
from jobmix.operators.runs import AP, JC, SRV

BUCKET_LABELS = {AP: "All-Purpose", JC: "Jobs-Compute", SRV: "Serverless"}


def is_bucket(name: str) -> Column:
    return F.col("primary_bucket") == F.lit(name)


def bucket_label(c: str = "primary_bucket") -> Column:
    """AP / JC / anything else -> display label."""
    return (F.when(F.col(c) == F.lit(AP), F.lit(BUCKET_LABELS[AP]))
            .when(F.col(c) == F.lit(JC), F.lit(BUCKET_LABELS[JC]))
            .otherwise(F.lit(BUCKET_LABELS[SRV])))


def adoption_summary(classified: DataFrame, by: Sequence[str] = (),
                     names: dict[str, str] | None = None,
                     pcts: dict[str, str] | None = None) -> DataFrame:
    """Job counts per bucket and their percentages, per ``by`` group.

    ``names`` maps output column -> bucket (or ``"*"`` for all jobs),
    ``pcts`` maps output column -> bucket.  With no ``by`` it is a global
    aggregate that always returns one row (counts of buckets are NULL there
    when no job is in range, the total is 0).
    """
    names = names or {"total_jobs": "*", "jobs_all_purpose": AP, "jobs_classic": JC,
                      "jobs_serverless": SRV}
    pcts = pcts or {}
    total = F.count(F.lit(1))
    aggs = []
    for out, bucket in names.items():
        aggs.append((total if bucket == "*" else cond_count(is_bucket(bucket))).alias(out))
    for out, bucket in pcts.items():
        aggs.append(pct(cond_count(is_bucket(bucket)), total).alias(out))
    grouped = classified.groupBy(*by) if by else classified
    return grouped.agg(*aggs)
