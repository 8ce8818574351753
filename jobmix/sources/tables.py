"""The six input tables as one bundle, and ways to load them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from jobmix import schemas

# Catalog names of the platform telemetry tables the reports are defined on.
SYSTEM_TABLES = {
    "workspaces": "system.access.workspaces_latest",
    "runs": "system.lakeflow.job_task_run_timeline",
    "clusters": "system.compute.clusters",
    "jobs": "system.lakeflow.jobs",
    "usage": "system.billing.usage",
    "prices": "system.billing.list_prices",
}


@dataclass(frozen=True)
class Tables:
    workspaces: DataFrame
    runs: DataFrame
    clusters: DataFrame
    jobs: DataFrame
    usage: DataFrame
    prices: DataFrame

    @classmethod
    def from_catalog(cls, spark: SparkSession, names: dict[str, str] | None = None) -> "Tables":
        """Read catalog tables lazily; Catalyst prunes columns and pushes filters."""
        names = {**SYSTEM_TABLES, **(names or {})}
        return cls(**{k: spark.table(v) for k, v in names.items()})

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "Tables":
        """Read ``<root>/<name>`` for each of the six names, with declared schemas.

        At scale the run timeline should be laid out by date of
        ``period_start_time`` and usage by ``usage_date`` so the date range
        prunes whole directories.
        """
        return cls(**{
            k: spark.read.schema(schemas.ALL_TABLES[k]).parquet(f"{root}/{k}")
            for k in schemas.ALL_TABLES
        })

    def check(self) -> dict[str, list[str]]:
        """Schema problems per table (empty dict when everything conforms)."""
        out = {}
        for name, expected in schemas.ALL_TABLES.items():
            problems = schemas.conforms(getattr(self, name).schema, expected)
            if problems:
                out[name] = problems
        return out
