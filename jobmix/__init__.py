"""jobmix: compute-adoption and spend analytics for scheduled jobs, on Spark.

The library turns six telemetry tables (workspaces, task-run timeline,
clusters, job names, billed usage, list prices) into the result tables of a
serverless-migration dashboard.  Everything is expressed with DataFrame
operations so Catalyst plans the joins, aggregations and windows.

Layout:

* ``jobmix.params``     -- the query parameters (date range, BU / env choices)
* ``jobmix.schemas``    -- StructTypes of the six input tables
* ``jobmix.sources``    -- loading the inputs (catalog, parquet, test fixtures)
* ``jobmix.functions``  -- column expressions and label rule sets
* ``jobmix.operators``  -- reusable DataFrame -> DataFrame steps
* ``jobmix.plans``      -- the 16 result tables, a shared-intermediate refresh
                           (``Dashboard``), the query registry and oracle SQL
* ``jobmix.cli``        -- ``python -m jobmix refresh``: write all result tables
"""

from jobmix.params import Params, TimeRange

__all__ = ["Params", "TimeRange"]
