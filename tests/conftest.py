from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark():
    from indexloom.session import local_session

    s = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
    yield s
    s.stop()
