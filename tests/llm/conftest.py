from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """A checkpoint folder for tests."""
    folder = "file://" + str(tmp_path_factory.mktemp("shared"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@pytest.fixture(autouse=True)
def _shared(shared):
    yield
