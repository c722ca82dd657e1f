"""One local session for all tests, and small helpers."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

TOP = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, TOP)
# Python workers import the package too.
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (TOP, os.environ.get("PYTHONPATH")) if p)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from attest.session import session

    settings = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.driver.memory": "3g",
    }
    got = session("local[4]", **settings)
    got.sparkContext.setLogLevel("ERROR")
    yield got
    got.stop()


@pytest.fixture
def sf():
    """The smallest of the driver's tables."""
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables are not here")
    return path
