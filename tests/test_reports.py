from __future__ import annotations

import pytest

from helpers import SF_SMALL, classic, run, srv
from jobmix.functions.rules import FIXTURE_BU_RULES
from jobmix.params import Params, TimeRange
from jobmix.plans import registry
from jobmix.plans import reports as D
from jobmix.plans.dashboard import Dashboard

RANGE = TimeRange("2024-01-01", "2024-01-31")
P = Params(RANGE)
WS = [("w1", "w-market-prod-r1"), ("w2", "w-risk-dev-r1"), ("w3", "w-misc-lab-r1")]
CLUSTERS = [("w1", "ap", "UI"), ("w1", "jc", "JOB"), ("w2", "ap", "API")]


@pytest.fixture(scope="module")
def fixture_results(spark):
    """All 16 tables on the sf0.001 fixture, collected once."""
    inp = registry.inputs(spark, SF_SMALL)
    with Dashboard(inp, registry.DEFAULT) as dash:
        return {k: df.collect() for k, df in dash.all().items()}


def test_empty_range_counts_zero_rest_null(make_tables):
    t = make_tables(workspaces=WS, clusters=CLUSTERS,
                    runs=[run("w1", "j", "r", "2024-01-02 00:00:00", [srv()])])
    empty = Params(TimeRange("2020-01-01", "2020-01-02"))
    row = D.kpi_headline(D.Inputs(t, FIXTURE_BU_RULES), empty).collect()[0]
    assert row.total_jobs == 0
    assert [row.jobs_all_purpose, row.jobs_classic, row.jobs_serverless, row.pct_serverless,
            row.pct_all_purpose, row.pct_classic] == [None] * 6
    spend = D.spend_kpi(D.Inputs(t, FIXTURE_BU_RULES), empty).collect()[0]
    assert list(spend) == [None, None, None]
    opp = D.bu_opportunities(D.Inputs(t, FIXTURE_BU_RULES), empty).collect()[0]
    assert (opp.bus_above_50pct, opp.bus_below_5pct, opp.largest_ap_fleet) == (0, 0, None)


def test_headline_counts_unmapped_per_bu_views_do_not(make_tables):
    t = make_tables(workspaces=WS, clusters=CLUSTERS, runs=[
        run("w1", "a", "r1", "2024-01-02 00:00:00", [classic("ap")]),
        run("w1", "b", "r2", "2024-01-02 00:00:00", [classic("jc")]),
        run("w2", "c", "r3", "2024-01-02 00:00:00", [srv()]),
        run("w3", "d", "r4", "2024-01-02 00:00:00", [srv()]),     # Unmapped BU
    ])
    inp = D.Inputs(t, FIXTURE_BU_RULES)
    h = D.kpi_headline(inp, P).collect()[0]
    assert (h.total_jobs, h.jobs_all_purpose, h.jobs_classic, h.jobs_serverless) == (4, 1, 1, 2)
    assert (h.pct_serverless, h.pct_all_purpose, h.pct_classic) == (50.0, 25.0, 25.0)
    sc = {r.bu: r.total_jobs for r in D.bu_scorecard(inp, P).collect()}
    assert sc == {"Market": 2, "Risk": 1}
    env = {r.env: r.total_jobs for r in D.env_kpi(inp, P).collect()}
    assert env == {"PROD": 2, "DEV": 1, "Unmapped": 1}


def test_opportunities_thresholds_use_rounded_pct_and_tie_break(make_tables):
    # Market: 1 AP of 2 jobs (50 % serverless); Risk: 1 AP of 1 job (0 %)
    t = make_tables(workspaces=WS, clusters=CLUSTERS, runs=[
        run("w1", "a", "r1", "2024-01-02 00:00:00", [classic("ap")]),
        run("w1", "b", "r2", "2024-01-02 00:00:00", [srv()]),
        run("w2", "c", "r3", "2024-01-02 00:00:00", [classic("ap")]),
    ])
    row = D.bu_opportunities(D.Inputs(t, FIXTURE_BU_RULES), P).collect()[0]
    assert (row.bus_above_50pct, row.bus_below_5pct) == (1, 1)
    assert row.largest_ap_fleet == "Risk"  # tie on 1 AP job: last BU alphabetically


def test_job_table_weighted_average_and_shared_names(make_tables):
    t = make_tables(
        workspaces=[("w1", "w-x-prod-r1"), ("w2", "w-x-prod-r1")],
        clusters=[("w1", "c", "JOB"), ("w1", "c", "PIPELINE"), ("w2", "c", "UI")],
        jobs=[("w1", "j", "old"), ("w1", "j", "new"), ("w2", "j", "zeta")],
        runs=[
            run("w1", "j", "r1", "2024-01-02 00:00:00", [classic("c")], duration=60),
            run("w1", "j", "r2", "2024-01-03 00:00:00", [srv(), classic("c")], duration=120),
            run("w2", "j", "r3", "2024-01-03 00:00:00", [classic("c")], duration=600),
            run("w2", "j", "r4", "2024-01-04 00:00:00", [classic("c")], duration=None),
        ])
    rows = D.job_table(D.Inputs(t, FIXTURE_BU_RULES), P).collect()
    assert len(rows) == 1
    r = rows[0]
    # w1 entries match 2 cluster rows x 2 name rows each; w2 entries 1 x 1
    expected_avg = round((60 * 4 + 120 * 4 + 600) / (4 + 4 + 1) / 60.0, 1)
    assert (r.workspace_name, r.job_name, r.compute_bucket) == ("w-x-prod-r1", "zeta", "JOBS_ON_ALL_PURPOSE")
    assert (r.run_count, r.active_days, r.avg_runtime_min, str(r.last_run_date)) == (
        4, 3, expected_avg, "2024-01-04")


def test_top_k_is_deterministic(make_tables):
    t = make_tables(workspaces=WS, clusters=CLUSTERS, runs=[
        run("w1", j, f"r{j}", "2024-01-02 00:00:00", [classic("jc")]) for j in "edcba"])
    rows = D.job_table(D.Inputs(t, FIXTURE_BU_RULES), P, limit=3).collect()
    assert [r.job_id for r in rows] == ["a", "b", "c"]


def test_fixture_invariants(fixture_results):
    r = fixture_results
    h = r["kpi_headline"][0]
    assert h.total_jobs == h.jobs_all_purpose + h.jobs_classic + h.jobs_serverless
    assert h.total_jobs == sum(x.total_jobs for x in r["env_kpi"])
    by_bu = {}
    for x in r["breakdown_by_bu"]:
        by_bu[x.bu] = by_bu.get(x.bu, 0) + x.jobs
    assert by_bu == {x.bu: x.total_jobs for x in r["bu_scorecard"]}
    shares = {}
    for x in r["bu_heatmap"]:
        shares[x.bu] = shares.get(x.bu, 0) + x.pct_of_bu
    assert all(abs(v - 100) <= 0.2 for v in shares.values())
    ts = r["time_series_counts"]
    assert [x.week for x in ts] == [x.week for x in r["time_series_pct"]]
    assert all(a.all_purpose + a.jobs_compute + a.serverless == b.total_jobs
               for a, b in zip(ts, r["time_series_pct"]))
    assert all(x.week.weekday() == 0 for x in ts)
    assert r["param_bu"][0].bu == "All" and "Unmapped" not in {x.bu for x in r["param_bu"]}
    assert "Unmapped" in {x.env for x in r["param_env"]}
    assert len(r["job_table"]) <= 500 and len(r["serverless_job_table"]) <= 500


def test_dashboard_equals_independent_queries(spark, fixture_results):
    inp = registry.inputs(spark, SF_SMALL)
    for name in ("kpi_headline", "bu_heatmap", "time_series_pct", "bu_trend"):
        alone = D.DATASETS[name](inp, registry.DEFAULT).collect()
        assert sorted(map(tuple, alone)) == sorted(map(tuple, fixture_results[name])), name


def test_input_order_does_not_matter(spark):
    inp = registry.inputs(spark, SF_SMALL)
    t = inp.tables
    shuffled = D.Inputs(type(t)(**{k: getattr(t, k).orderBy("workspace_id" if k != "prices" else "sku_name",
                                                              ascending=False)
                                    for k in ("workspaces", "runs", "clusters", "jobs", "usage", "prices")}), FIXTURE_BU_RULES)
    for name in ("kpi_headline", "spend_kpi", "job_table"):
        a = D.DATASETS[name](inp, registry.DEFAULT).collect()
        b = D.DATASETS[name](shuffled, registry.DEFAULT).collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b)), name


def test_dashboard_filtered_equals_independent_queries(spark):
    inp = registry.inputs(spark, SF_SMALL)
    p = Params(registry.FULL_RANGE, bu=("Risk", "Market", "Unmapped"), env=("PROD", "DEV"))
    with Dashboard(inp, p) as dash:
        for name in ("kpi_headline", "breakdown_by_env", "bu_scorecard", "bu_trend",
                     "time_series_counts", "bu_opportunities"):
            a = sorted(map(tuple, dash.table(name).collect()))
            b = sorted(map(tuple, D.DATASETS[name](inp, p).collect()))
            assert a == b, name


def test_largest_ap_fleet_named_even_with_no_ap_jobs(make_tables):
    t = make_tables(workspaces=WS, clusters=CLUSTERS, runs=[
        run("w2", "c", "r1", "2024-01-02 00:00:00", [srv()]),
        run("w1", "a", "r2", "2024-01-02 00:00:00", [srv()]),
    ])
    row = D.bu_opportunities(D.Inputs(t, FIXTURE_BU_RULES), P).collect()[0]
    assert (row.bus_above_50pct, row.bus_below_5pct, row.largest_ap_fleet) == (2, 0, "Risk")


def test_tables_from_catalog(spark):
    from jobmix.sources import Tables
    derived = registry.inputs(spark, SF_SMALL).tables
    names = {}
    for k in ("workspaces", "runs", "clusters", "jobs", "usage", "prices"):
        getattr(derived, k).createOrReplaceTempView(f"jm_{k}")
        names[k] = f"jm_{k}"
    inp = D.Inputs(Tables.from_catalog(spark, names), FIXTURE_BU_RULES)
    assert inp.tables.check() == {}
    a = D.kpi_headline(inp, registry.DEFAULT).collect()
    b = D.kpi_headline(D.Inputs(derived, FIXTURE_BU_RULES), registry.DEFAULT).collect()
    assert a == b


def test_all_tables_run_on_empty_inputs(make_tables):
    t = make_tables()
    inp = D.Inputs(t, FIXTURE_BU_RULES)
    out = {name: fn(inp, P).collect() for name, fn in D.DATASETS.items()}
    assert out["kpi_headline"][0].total_jobs == 0
    assert list(out["spend_kpi"][0]) == [None, None, None]
    assert list(out["bu_opportunities"][0]) == [0, 0, None]
    assert [r.bu for r in out["param_bu"]] == ["All"]
    assert [r.env for r in out["param_env"]] == ["All"]
    for name in ("breakdown_by_bu", "bu_trend", "job_table", "serverless_job_table", "env_kpi"):
        assert out[name] == [], name


def test_dashboard_storage_level_and_release(spark):
    from pyspark import StorageLevel
    inp = registry.inputs(spark, SF_SMALL)
    with Dashboard(inp, registry.DEFAULT, storage_level=StorageLevel.DISK_ONLY) as dash:
        dash.table("kpi_headline").collect()
        cached = list(dash._cache.values())
        assert cached and all(df.storageLevel == StorageLevel.DISK_ONLY for df in cached)
    assert all(not df.is_cached for df in cached)


def test_sorted_tables_come_in_their_order(spark):
    """Order of every sorted table, on data with several labels and ties."""
    inp = registry.inputs(spark, SF_SMALL)
    p = registry.DEFAULT
    for name, keys in (("breakdown_by_bu", ["bu"]), ("breakdown_by_env", ["env"]), ("env_kpi", ["env"]),
                       ("bu_heatmap", ["bu", "compute_type"]), ("env_heatmap", ["env", "compute_type"]),
                       ("bu_trend", ["week", "bu"]), ("time_series_counts", ["week"]),
                       ("time_series_pct", ["week"]), ("param_bu", ["bu"]), ("param_env", ["env"])):
        rows = [tuple(r[k] for k in keys) for r in D.DATASETS[name](inp, p).collect()]
        assert len(rows) > 1 and rows == sorted(rows), name
    rows = [(-r.total_jobs, r.bu) for r in D.bu_scorecard(inp, p).collect()]
    assert len(rows) > 1 and rows == sorted(rows)
    rows = [(-r.run_count, r.workspace_name, r.job_id) for r in D.job_table(inp, p).collect()]
    assert rows == sorted(rows)
    rows = [(-r.serverless_dbus, r.workspace_name, r.job_id) for r in D.serverless_job_table(inp, p).collect()]
    assert rows == sorted(rows)


def test_share_just_below_a_threshold_counts_rounded(make_tables):
    """99 of 2000 jobs on serverless are 4.95 %, which rounds to 5.0 and is not below 5."""
    runs = [run("w1", f"j{i}", f"r{i}", "2024-01-02 00:00:00", [srv()] if i < 99 else [classic("jc")])
            for i in range(2000)]
    t = make_tables(workspaces=[("w1", "w-market-prod-r1")], clusters=[("w1", "jc", "JOB")], runs=runs)
    row = D.bu_opportunities(D.Inputs(t, FIXTURE_BU_RULES), P).collect()[0]
    assert (row.bus_above_50pct, row.bus_below_5pct) == (0, 0)
    assert D.kpi_headline(D.Inputs(t, FIXTURE_BU_RULES), P).collect()[0].pct_serverless == 5.0
