from __future__ import annotations

from helpers import SF_SMALL
import json

import pytest

from jobmix.functions.rules import FIXTURE_BU_RULES
from jobmix.cli import parse, refresh
from jobmix.plans import registry
from jobmix.plans import reports as D
from jobmix.sources.fixtures import derive_tables
from jobmix.sources.layout import write_tables


def test_refresh_writes_every_table(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    write_tables(derive_tables(spark, SF_SMALL), src, by_day=False, files=2)
    rules = tmp_path / "rules.json"
    rules.write_text(json.dumps({"bu": [vars(r) for r in FIXTURE_BU_RULES]}))
    args = parse(["refresh", "--rules", str(rules), "--from", "1995-01-01", "--to", "2001-12-31", "--env", "PROD",
                  "--source", f"parquet:{src}", "--out", out,
                  "--tables", "kpi_headline", "job_table", "param_env"])
    written = refresh(spark, args)
    assert written == [f"{out}/kpi_headline", f"{out}/job_table", f"{out}/param_env"]
    p = registry.DEFAULT.with_(env=("PROD",))
    expected = D.kpi_headline(registry.inputs(spark, SF_SMALL), p).collect()
    assert spark.read.parquet(f"{out}/kpi_headline").collect() == expected
    assert spark.read.parquet(f"{out}/job_table").count() <= 500


def test_refresh_without_rules_is_refused(spark, tmp_path):
    args = parse(["refresh", "--from", "1995-01-01", "--to", "1995-12-31", "--source", f"parquet:{tmp_path}",
                  "--out", str(tmp_path / "out")])
    with pytest.raises(SystemExit, match="no label rules"):
        refresh(spark, args)


def test_refresh_with_tag_and_rate(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    write_tables(derive_tables(spark, SF_SMALL), src, by_day=False, files=2)
    base = ["refresh", "--from", "1995-01-01", "--to", "2001-12-31", "--bu-tag", "bu", "--bu", "tag_1",
            "--source", f"parquet:{src}", "--tables", "spend_kpi", "serverless_job_table"]
    refresh(spark, parse([*base, "--out", out]))
    refresh(spark, parse([*base, "--rate", "2", "--out", f"{out}2"]))
    one, two = (spark.read.parquet(f"{o}/spend_kpi").first() for o in (out, f"{out}2"))
    assert one.serverless_spend > 0 and two.serverless_spend == pytest.approx(2 * one.serverless_spend, abs=0.02)
    assert {r.bu for r in spark.read.parquet(f"{out}/serverless_job_table").collect()} == {"tag_1"}
