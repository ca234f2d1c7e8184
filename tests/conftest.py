"""One small session for all tests; the package is importable from the repository's top."""

import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(TOP))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from silexa.session import get_session, ship

    session = get_session(
        "tests", "local[*]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"}
    )
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
