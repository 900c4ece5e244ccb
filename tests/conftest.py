import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from arborlake.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    found = session("local[*]", "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g", "spark.arborlake.salts": "3",
    })
    found.sparkContext.setLogLevel("ERROR")
    return found


@pytest.fixture(scope="session")
def grid():
    from arborlake.bridge import GRID

    return GRID


@pytest.fixture
def no_broadcast(monkeypatch, spark):
    """Take the salted join everywhere, as beyond the broadcast bound."""
    from arborlake import session as module

    monkeypatch.setattr(module, "fits_broadcast", lambda *a, **k: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
