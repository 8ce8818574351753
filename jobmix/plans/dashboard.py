"""All 16 result tables of one dashboard refresh, sharing intermediates.

Eleven tables classify jobs (eight per job over the range, three per week).
All of them are answered from one table of per-(week, workspace, job) usage
flags, built with a single pass over the run timeline and persisted
(memory, spilling to disk) for the refresh.  It holds one row per job and
week -- bounded by the number of jobs, not of runs -- and BU / env filters
apply to it as columns.  The per-job and per-week classifications derived
from it (one row per job, or per job and week) are persisted as well, so the
eight per-job tables aggregate only the per-job rows.  A lost executor only costs recomputing its cached
blocks from lineage; nothing is checkpointed locally.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from jobmix.operators import runs as R
from jobmix.params import Params
from jobmix.plans import reports as D


@dataclass(frozen=True)
class _SharedInputs(D.Inputs):
    """``Inputs`` whose classifications come from the dashboard's flag table."""

    dashboard: "Dashboard | None" = None

    def kinds(self) -> DataFrame:
        return self.dashboard.kinds()

    def classified(self, params: Params) -> DataFrame:
        return self.dashboard.shared(
            ("classified", params),
            lambda: R.classify_flags(self.dashboard.flags(params), R.JOB_KEYS, params))

    def weekly(self, params: Params, keys: Sequence[str] = ("week", "job_id"),
               use_env: bool = True, drop_unmapped_bu: bool = False) -> DataFrame:
        return self.dashboard.shared(
            ("weekly", params, tuple(keys), use_env, drop_unmapped_bu),
            lambda: R.classify_flags(self.dashboard.flags(params), keys, params, use_env=use_env,
                                     drop_unmapped_bu=drop_unmapped_bu))


class Dashboard:
    """``with Dashboard(inputs, params) as d: tables = d.all()``."""

    def __init__(self, inputs: D.Inputs, params: Params,
                 storage_level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        """``storage_level``: where the shared tables are kept.  With frequent
        executor loss a replicated level (``MEMORY_AND_DISK_2``) keeps a copy
        elsewhere instead of recomputing lost blocks from the timeline."""
        self.params = params
        self.storage_level = storage_level
        self._cache: dict = {}
        self._base = inputs
        self.inputs = _SharedInputs(inputs.tables, inputs.bu_rules, inputs.env_rules, inputs.bu_tag,
                                    inputs.rate, self)

    def shared(self, key, build) -> DataFrame:
        """Build once per refresh and persist (memory, spilling to disk)."""
        if key not in self._cache:
            self._cache[key] = build().persist(self.storage_level)
        return self._cache[key]

    def kinds(self) -> DataFrame:
        """The collapsed cluster table, built once per refresh."""
        return self.shared(("kinds",), self._base.kinds)

    def flags(self, params: Params) -> DataFrame:
        return self.shared(("flags", params.time_range), lambda: R.job_week_flags(
            self._base.tables.runs, self.kinds(), self._base.ws(), params.time_range))

    def table(self, name: str) -> DataFrame:
        return D.DATASETS[name](self.inputs, self.params)

    def all(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in D.DATASETS}

    def close(self) -> None:
        for df in self._cache.values():
            df.unpersist()
        self._cache.clear()

    def __enter__(self) -> "Dashboard":
        return self

    def __exit__(self, *exc) -> None:
        self.close()
