from __future__ import annotations

import sys

import pytest

from helpers import ROOT

sys.path.insert(0, ROOT)

from jobmix import schemas  # noqa: E402
from jobmix.sources.tables import Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from jobmix.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app_name="jobmix-tests")
    yield s
    s.stop()


@pytest.fixture
def make_tables(spark):
    """Build a Tables bundle from Python rows (any table may be omitted)."""
    def build(workspaces=(), runs=(), clusters=(), jobs=(), usage=(), prices=()) -> Tables:
        data = {"workspaces": workspaces, "runs": runs, "clusters": clusters, "jobs": jobs,
                "usage": usage, "prices": prices}
        return Tables(**{k: spark.createDataFrame(list(v), schemas.ALL_TABLES[k])
                         for k, v in data.items()})
    return build
