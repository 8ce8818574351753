"""Joins against dimension tables, with a checked broadcast.

A side is broadcast only when Catalyst's size estimate for it is within a
bound.  Beyond the bound the join is left to the planner (sort-merge or
shuffle-hash); AQE still turns it into a broadcast at runtime if the real
shuffle output turns out small, and splits skewed partitions otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default bound for an explicit broadcast; override per session with
# ``spark.conf.set("jobmix.broadcast.maxBytes", ...)``.  For files the
# estimate counts compressed bytes, so the in-memory side can be a few times
# larger: keep the bound well below what an executor can hold.
DEFAULT_BROADCAST_MAX_BYTES = 32 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df`` (an upper-bound style guess); None where a
    session has no local plan to ask (Spark Connect): then nothing is hinted and the
    planner decides from its own statistics."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return None
    return int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_bound(df: DataFrame) -> int:
    value = df.sparkSession.conf.get("jobmix.broadcast.maxBytes", None)
    return DEFAULT_BROADCAST_MAX_BYTES if value is None else int(value)


def fits_broadcast(df: DataFrame, max_bytes: int | None = None) -> bool:
    size = estimated_bytes(df)
    bound = broadcast_bound(df) if max_bytes is None else max_bytes
    return size is not None and size <= bound


def dimension_join(fact: DataFrame, dim: DataFrame, on: list[str] | Column,
                   how: str = "left", max_bytes: int | None = None) -> DataFrame:
    """``fact JOIN dim``; broadcast ``dim`` only when its estimate fits."""
    if fits_broadcast(dim, max_bytes):
        dim = F.broadcast(dim)
    return fact.join(dim, on, how)
