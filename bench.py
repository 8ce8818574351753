"""Benchmark: the 16 dashboard result tables at one scale factor.

Environment:
  BENCH_SF_DIR    test data directory (default /root/testdata/sf0.1)
  BENCH_CPUS      local[N] threads (default 8)
  BENCH_REPEATS   timed runs per query after one warm-up (default 5)
  BENCH_WORK_DIR  where the derived input tables are stored (default: a new
                  folder under /tmp; on a cluster use shared storage)

Two measurements:

* ``queries`` (the headline ``value`` is their sum): the six telemetry tables
  are derived from the test tables by Spark and stored once, as a warehouse
  holds them (``load_sec``); each result table is then computed from the
  stored tables.
* ``queries_from_raw``: each result table derives its inputs from the raw
  test tables on the fly (what the registered driver queries do).

Each run executes the whole plan (``write.format("noop")``); per table the
median of the timed runs is reported.  ``refresh_all_sec`` is one pass over
all 16 tables sharing the persisted per-week flag table, as a dashboard
refresh runs them.  One more pass over the stored inputs runs each table in
its own job group with Spark's event log written to the scratch folder;
``shuffle_bytes`` and ``peak_execution_memory`` per table are read from that
log.  ``quarter`` compares two layouts of a year of the same tables, plain files
and directories by day, for two tables over one quarter: seconds, files and
rows read.  Prints one JSON line.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time
from dataclasses import replace

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from jobmix.functions.rules import FIXTURE_BU_RULES  # noqa: E402
from jobmix.params import Params, TimeRange  # noqa: E402
from jobmix.plans import registry, reports  # noqa: E402
from jobmix.plans.dashboard import Dashboard  # noqa: E402
from jobmix.session import build_session  # noqa: E402
from jobmix.sources import Tables  # noqa: E402
from jobmix.sources.fixtures import derive_tables  # noqa: E402
from jobmix.sources.layout import write_tables  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def time_tables(inputs, params, repeats: int) -> dict[str, float]:
    for fn in reports.DATASETS.values():
        run(fn(inputs, params))  # warm-up pass over every table: JIT, file listing
    out = {}
    for name, fn in reports.DATASETS.items():
        samples = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            run(fn(inputs, params))
            samples.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(samples), 4)
    return out


def measure_pass(spark, inputs, params) -> None:
    """One run per table, each in its own job group (read back from the event log)."""
    sc = spark.sparkContext
    for name, fn in reports.DATASETS.items():
        sc.setJobGroup(f"bench:{name}", name)
        run(fn(inputs, params))
    sc.setJobGroup("bench:other", "other")


def read_event_log(log_dir: str) -> dict[str, dict[str, int]]:
    """Per job group: shuffle bytes written and peak execution memory."""
    stage_group, out = {}, {}
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if not os.path.isfile(path):
            continue
        with open(path) as f:
            events = [json.loads(line) for line in f if line.strip()]
        for ev in events:
            if ev.get("Event") == "SparkListenerJobStart":
                group = (ev.get("Properties") or {}).get("spark.jobGroup.id", "")
                for sid in ev.get("Stage IDs", []):
                    stage_group[sid] = group
        for ev in events:
            if ev.get("Event") != "SparkListenerTaskEnd":
                continue
            group = stage_group.get(ev.get("Stage ID"), "")
            if not group.startswith("bench:") or group == "bench:other":
                continue
            m = ev.get("Task Metrics") or {}
            acc = out.setdefault(group.removeprefix("bench:"),
                                 {"shuffle_bytes": 0, "peak_execution_memory": 0})
            acc["shuffle_bytes"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
            acc["peak_execution_memory"] = max(acc["peak_execution_memory"],
                                               m.get("Peak Execution Memory", 0))
    return out


def one_year(tables: Tables) -> Tables:
    """The tables with 1998 of the timeline and the usage: a directory for each day of it."""
    return replace(tables, runs=tables.runs.where("year(period_start_time) = 1998"),
                   usage=tables.usage.where("year(usage_date) = 1998"))


QUARTER = ("kpi_headline", "spend_kpi")


def quarter_pass(spark, layouts: dict, params, repeats: int) -> dict[str, dict]:
    """Seconds of the ``QUARTER`` tables on each layout; one more run each under its own job group."""
    out = {}
    for layout, inputs in layouts.items():
        for name in QUARTER:
            fn, samples = reports.DATASETS[name], []
            run(fn(inputs, params))
            for _ in range(repeats):
                t0 = time.perf_counter()
                run(fn(inputs, params))
                samples.append(time.perf_counter() - t0)
            spark.sparkContext.setJobGroup(f"quarter:{name}:{layout}", name)
            run(fn(inputs, params))
            spark.sparkContext.setJobGroup("bench:other", "other")
            out[f"{name}:{layout}"] = {"sec": round(statistics.median(samples), 4)}
    return out


def read_scans(log_dir: str) -> dict[str, dict[str, int]]:
    """Per job group of :func:`quarter_pass`: files that the scans opened and rows that they read."""
    group_of, stage_group, files_metric, out = {}, {}, set(), {}

    def metrics(node: dict):
        files_metric.update(m["accumulatorId"] for m in node["metrics"] if m["name"] == "number of files read")
        for child in node["children"]:
            metrics(child)

    def add(group: str, what: str, n: int) -> None:
        if group.startswith("quarter:"):
            acc = out.setdefault(group.removeprefix("quarter:"), {"files": 0, "rows": 0})
            acc[what] += n

    events = []
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isfile(path):
            with open(path) as f:
                events += [json.loads(line) for line in f if line.strip()]
    for ev in events:
        if "sparkPlanInfo" in ev:
            metrics(ev["sparkPlanInfo"])
        if ev.get("Event") == "SparkListenerJobStart":
            properties = ev.get("Properties") or {}
            group = properties.get("spark.jobGroup.id", "")
            group_of[int(properties.get("spark.sql.execution.id", -1))] = group
            stage_group.update(dict.fromkeys(ev.get("Stage IDs", []), group))
    for ev in events:
        if ev.get("Event", "").endswith("SparkListenerDriverAccumUpdates"):
            n = sum(v for k, v in ev["accumUpdates"] if k in files_metric)
            add(group_of.get(ev["executionId"], ""), "files", n)
        elif ev.get("Event") == "SparkListenerTaskEnd":
            n = ((ev.get("Task Metrics") or {}).get("Input Metrics") or {}).get("Records Read", 0)
            add(stage_group.get(ev.get("Stage ID"), ""), "rows", n)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "5"))
    work = os.environ.get("BENCH_WORK_DIR") or tempfile.mkdtemp(prefix="jobmix-bench-", dir="/tmp")
    log_dir = os.path.join(work, "events")
    os.makedirs(log_dir, exist_ok=True)
    spark = build_session(f"local[{cpus}]", shuffle_partitions=2 * cpus,
                          extra={"spark.driver.memory": "16g", "spark.eventLog.enabled": "true",
                                 "spark.eventLog.dir": log_dir,
                                 "spark.eventLog.compress": "false",
                                 "spark.eventLog.rolling.enabled": "false"})
    params = registry.DEFAULT

    t0 = time.perf_counter()
    store = os.path.join(work, "tables")
    write_tables(derive_tables(spark, sf_dir), store, by_day=False, files=2 * cpus)
    load_sec = time.perf_counter() - t0
    stored = reports.Inputs(Tables.from_parquet(spark, store), FIXTURE_BU_RULES)

    timings = time_tables(stored, params, repeats)
    raw = time_tables(registry.inputs(spark, sf_dir), params, max(1, min(repeats, 3)))

    refresh = []
    for _ in range(max(1, min(repeats, 3))):
        t0 = time.perf_counter()
        with Dashboard(stored, params) as dash:
            for df in dash.all().values():
                run(df)
        refresh.append(time.perf_counter() - t0)

    measure_pass(spark, stored, params)

    layouts = {}
    for layout, by_day in (("plain", False), ("by_day", True)):
        path = os.path.join(work, f"year_{layout}")
        write_tables(one_year(Tables.from_parquet(spark, store)), path, by_day=by_day, files=2 * cpus)
        layouts[layout] = reports.Inputs(Tables.from_parquet(spark, path), FIXTURE_BU_RULES)
    quarter = quarter_pass(spark, layouts, Params(TimeRange("1998-04-01", "1998-06-30")), 1)
    spark.stop()
    metrics = read_event_log(log_dir)
    for key, scans in read_scans(log_dir).items():
        quarter[key] |= scans

    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "dashboard_16_tables_sum_of_medians_on_stored_inputs",
        "value": round(sum(timings.values()), 4),
        "unit": "sec",
        "queries": timings,
        "refresh_all_sec": round(statistics.median(refresh), 4),
        "load_sec": round(load_sec, 4),
        "queries_from_raw_sum": round(sum(raw.values()), 4),
        "queries_from_raw": raw,
        "quarter": quarter,
        "shuffle_bytes": {k: v["shuffle_bytes"] for k, v in metrics.items()},
        "peak_execution_memory": {k: v["peak_execution_memory"] for k, v in metrics.items()},
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "repeats": repeats,
    }))


if __name__ == "__main__":
    main()
