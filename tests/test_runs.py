from __future__ import annotations

import pytest

from helpers import classic, d, run, srv
from jobmix.functions.rules import FIXTURE_BU_RULES
from jobmix.operators import runs as R
from jobmix.params import Params, TimeRange
from jobmix.plans import reports as D

RANGE = TimeRange("2024-01-01", "2024-01-31")
P = Params(RANGE)
WS = [("w1", "w-market-prod-r1"), ("w2", "w-risk-dev-r1")]
CLUSTERS = [("w1", "ap1", "UI"), ("w1", "ap2", "API"), ("w1", "jc1", "JOB"),
            ("w1", "pl1", "PIPELINE"), ("w2", "ap1", "JOB")]


def _classes(tables, params=P, broadcast=None):
    inp = D.Inputs(tables, FIXTURE_BU_RULES)
    entries = R.keep_job_compute(R.explode_runs(tables.runs, params.time_range,
                                                ("workspace_id", "job_id")))
    tagged = R.tag_runs(entries, inp.ws(), params)
    b = R.bucket_runs(tagged, tables.clusters, broadcast=broadcast)
    out = R.classify_jobs(b, R.JOB_KEYS)
    return {(r.workspace_id, r.job_id): r.primary_bucket for r in out.collect()}


def test_explode_drops_null_and_empty_arrays(make_tables):
    t = make_tables(workspaces=WS, runs=[
        run("w1", "a", "r1", "2024-01-05 10:00:00", None),
        run("w1", "b", "r2", "2024-01-05 10:00:00", []),
        run("w1", "c", "r3", "2024-01-05 10:00:00", [srv(), classic("jc1")]),
    ])
    rows = R.explode_runs(t.runs, RANGE).collect()
    assert sorted((r.job_id, r.compute_type) for r in rows) == [
        ("c", "CLASSIC_COMPUTE"), ("c", "SERVERLESS_COMPUTE")]


def test_time_range_is_half_open_on_timestamps(make_tables):
    t = make_tables(runs=[
        run("w1", "in_min", "r1", "2024-01-01 00:00:00", [srv()]),
        run("w1", "before", "r2", "2023-12-31 23:59:59", [srv()]),
        run("w1", "last", "r3", "2024-01-31 23:59:59", [srv()]),
        run("w1", "after", "r4", "2024-02-01 00:00:00", [srv()]),
    ])
    jobs = {r.job_id for r in R.explode_runs(t.runs, RANGE).collect()}
    assert jobs == {"in_min", "last"}


@pytest.mark.parametrize("broadcast", [True, False])
def test_bucket_rules_and_worst_wins(make_tables, broadcast):
    t = make_tables(workspaces=WS, clusters=CLUSTERS, runs=[
        run("w1", "srv_only", "r1", "2024-01-02 00:00:00", [srv()]),
        run("w1", "mixed_jc", "r2", "2024-01-02 00:00:00", [srv()]),
        run("w1", "mixed_jc", "r3", "2024-01-03 00:00:00", [classic("jc1")]),
        run("w1", "mixed_ap", "r4", "2024-01-02 00:00:00", [srv(), classic("jc1")]),
        run("w1", "mixed_ap", "r5", "2024-01-09 00:00:00", [classic("ap2")]),
        run("w1", "no_meta", "r6", "2024-01-02 00:00:00", [classic("unknown")]),
        run("w1", "pipeline", "r7", "2024-01-02 00:00:00", [classic("pl1")]),
        # same cluster id, other workspace, whose row says JOB: not AP
        run("w2", "other_ws", "r8", "2024-01-02 00:00:00", [classic("ap1")]),
        # a type that is neither serverless nor classic: the job vanishes
        run("w1", "other_type", "r9", "2024-01-02 00:00:00",
            [{"type": "OTHER_COMPUTE", "cluster_id": None}]),
    ])
    got = _classes(t, broadcast=broadcast)
    assert got == {("w1", "srv_only"): "SRV", ("w1", "mixed_jc"): "JC", ("w1", "mixed_ap"): "AP",
                   ("w1", "no_meta"): "JC", ("w1", "pipeline"): "JC", ("w2", "other_ws"): "JC"}


def test_cluster_with_both_kinds_of_rows_is_ap_and_weights_fan_out(make_tables):
    t = make_tables(clusters=[("w1", "c", "UI"), ("w1", "c", "JOB"), ("w1", "c", "JOB")], runs=[
        run("w1", "j", "r1", "2024-01-02 00:00:00", [classic("c")]),
    ])
    e = R.explode_runs(t.runs, RANGE, ("workspace_id", "job_id"))
    rows = sorted((r.bucket, r.weight) for r in R.bucket_runs(e, t.clusters).collect())
    assert rows == [("AP", 1), ("JC", 2)]


def test_missing_workspace_is_unmapped_and_named_by_id(make_tables):
    t = make_tables(workspaces=WS, runs=[run("w9", "j", "r1", "2024-01-02 00:00:00", [srv()])])
    inp = D.Inputs(t, FIXTURE_BU_RULES)
    tagged = R.tag_runs(R.explode_runs(t.runs, RANGE, ("workspace_id", "job_id")), inp.ws(), P)
    r = tagged.collect()[0]
    assert (r.bu, r.env, r.workspace_name) == ("Unmapped", "Unmapped", "w9")


@pytest.mark.parametrize("bu, expected", [
    ((), set()),
    (("All", "Nope"), {"w1", "w2", "w9"}),
    (("Unmapped",), {"w9"}),
    (("Market",), {"w1"}),
])
def test_multi_select_choices(make_tables, bu, expected):
    t = make_tables(workspaces=WS, runs=[
        run(w, "j", "r", "2024-01-02 00:00:00", [srv()]) for w in ("w1", "w2", "w9")])
    got = {k[0] for k in _classes(t, Params(RANGE, bu=bu))}
    assert got == expected


def test_null_choice_rejected():
    with pytest.raises(ValueError):
        Params(RANGE, bu=("All", None))


def test_weekly_sunday_and_monday_are_different_weeks(make_tables):
    t = make_tables(workspaces=WS, clusters=CLUSTERS, runs=[
        run("w1", "j", "r1", "2024-01-07 12:00:00", [srv()]),          # Sunday
        run("w1", "j", "r2", "2024-01-08 00:00:00", [classic("ap1")]),  # Monday
    ])
    inp = D.Inputs(t, FIXTURE_BU_RULES)
    rows = inp.weekly(P).collect()
    assert sorted((r.week, r.primary_bucket) for r in rows) == [
        (d("2024-01-01"), "SRV"), (d("2024-01-08"), "AP")]


def test_weekly_key_merges_equal_job_ids_across_workspaces(make_tables):
    t = make_tables(workspaces=WS, clusters=CLUSTERS, runs=[
        run("w1", "j", "r1", "2024-01-02 00:00:00", [classic("ap1")]),
        run("w2", "j", "r2", "2024-01-02 00:00:00", [srv()]),
    ])
    rows = D.Inputs(t, FIXTURE_BU_RULES).weekly(P).collect()
    assert [(r.job_id, r.primary_bucket) for r in rows] == [("j", "AP")]
