"""Property: Spark's CASE chain equals a plain first-match evaluation of the rules."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from jobmix.functions.rules import ENV_RULES, FIXTURE_BU_RULES
from jobmix.operators.labels import workspace_labels

TOKENS = ["w", "risk", "RISK", "Market", "ingest", "daas", "retail", "legacy", "misc", "dev", "prod",
          "nonprod", "qat", "ppe", "beta", "sandbox", "test", "r1", "x"]


def first_match(name, rules, default="Unmapped"):
    if name is None:
        return default
    for r in rules:
        if r.kind == "one_of" and name in r.values:
            return r.label
        if r.kind == "contains" and any(v.lower() in name.lower() for v in r.values):
            return r.label
    return default


names = st.one_of(
    st.none(),
    st.lists(st.sampled_from(TOKENS), min_size=1, max_size=5).map("-".join),
    st.sampled_from(["w-legacy-prod-r1", "w-legacy-qat-r1", "w-risk-ppe-r1", "W-LEGACY-PROD-R1"]),
)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(names, min_size=1, max_size=60))
def test_labels_match_first_match_semantics(spark, batch):
    rows = [(str(i), n) for i, n in enumerate(batch)]
    df = spark.createDataFrame(rows, "workspace_id string, workspace_name string")
    got = {r.workspace_id: (r.bu, r.env) for r in workspace_labels(df, FIXTURE_BU_RULES).collect()}
    for i, n in rows:
        assert got[i] == (first_match(n, FIXTURE_BU_RULES), first_match(n, ENV_RULES)), n
