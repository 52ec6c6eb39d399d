from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session("tests", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{shared}"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
