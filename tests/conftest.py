import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[8]", 4, "tidemark-tests", **{
        "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def pieces(monkeypatch):
    """Call with a number of rows to have running scans cut into pieces of about that many."""
    from tidemark.plans import ordered

    def force(rows: int):
        monkeypatch.setattr(ordered, "SMALL_BYTES", 0)
        monkeypatch.setattr(ordered, "PIECE_ROWS", rows)

    return force
