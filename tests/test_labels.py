from __future__ import annotations


import pytest

from jobmix.functions.rules import ENV_RULES, FIXTURE_BU_RULES, contains, one_of
from jobmix.operators.labels import label_by_rules, label_from_tag, workspace_labels


def _labels(spark, names, rules):
    df = spark.createDataFrame([(n,) for n in names], "workspace_name string")
    out = label_by_rules(df, "workspace_name", rules, "label")
    return {r.workspace_name: r.label for r in out.collect()}


def test_first_match_wins_and_dead_exact_entry(spark):
    got = _labels(spark, ["w-risk-ppe-r1", "w-legacy-qat-r1", "w-legacy-dev-r1"], FIXTURE_BU_RULES)
    # "w-risk-ppe-r1" is in the exact list too, but the earlier contains rule takes it.
    assert got == {"w-risk-ppe-r1": "Risk", "w-legacy-qat-r1": "Legacy",
                   "w-legacy-dev-r1": "Unmapped"}


def test_contains_ignores_case_exact_does_not(spark):
    got = _labels(spark, ["w-RISK-dev-r1", "W-LEGACY-PROD-R1", "W-Market-x"], FIXTURE_BU_RULES)
    assert got == {"w-RISK-dev-r1": "Risk", "W-LEGACY-PROD-R1": "Unmapped", "W-Market-x": "Market"}


def test_env_needs_hyphen_on_both_sides_and_dev_beats_prod(spark):
    got = _labels(spark, ["w-a-prod-r1", "w-a-prod", "w-dev-prod-x", "w-a-nonprod-r1",
                          "w-a-beta-r1", "w-a-lab-r1"], ENV_RULES)
    assert got == {"w-a-prod-r1": "PROD", "w-a-prod": "Unmapped", "w-dev-prod-x": "DEV",
                   "w-a-nonprod-r1": "DEV", "w-a-beta-r1": "PROD", "w-a-lab-r1": "Unmapped"}


def test_null_name_is_unmapped(spark):
    df = spark.createDataFrame([("1", None)], "workspace_id string, workspace_name string")
    row = workspace_labels(df, FIXTURE_BU_RULES).collect()[0]
    assert (row.bu, row.env) == ("Unmapped", "Unmapped")


def test_rules_are_replaceable(spark):
    rules = [one_of("Exact", "abc"), contains("Sub", "b")]
    assert _labels(spark, ["abc", "xbx", "ABC"], rules) == {"abc": "Exact", "xbx": "Sub", "ABC": "Sub"}


def test_label_from_tag(spark):
    df = spark.createDataFrame([({"bu": "x"},), ({},), (None,), ({"other": "y"},)],
                               "custom_tags map<string,string>")
    got = [r.bu for r in label_from_tag(df, "bu").collect()]
    assert got == ["x", "Unmapped", "Unmapped", "Unmapped"]


def test_all_environment_infixes(spark):
    """Every infix and its label, spelled out."""
    want = {"dev": "DEV", "sandbox": "DEV", "test": "DEV", "nonprod": "DEV", "qat": "QAT", "ppe": "PPE",
            "prod": "PROD", "beta": "PROD", "lab": "Unmapped"}
    df = spark.createDataFrame([(k, f"w-X-{k.upper()}-r1") for k in want], "workspace_id string, workspace_name string")
    assert {r.workspace_id: r.env for r in workspace_labels(df, FIXTURE_BU_RULES).collect()} == want


def test_rules_from_a_file(tmp_path):
    from jobmix.functions.rules import load_rules
    path = tmp_path / "r.json"
    path.write_text('{"bu": [{"label": "A", "kind": "contains", "values": ["x"]}]}')
    assert load_rules(str(path)) == {"bu": (contains("A", "x"),), "env": ENV_RULES}
    path.write_text('{"env": []}')
    with pytest.raises(ValueError, match="no 'bu' rules"):
        load_rules(str(path))
