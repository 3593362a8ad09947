"""One local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tarnmill.runtime import local_session

    session = local_session(4, 4, **{"spark.driver.memory": "4g", "spark.sql.execution.arrow.maxRecordsPerBatch": "500"})
    yield session
    session.stop()
