import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from estatescope import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def snapshot_path(tmp_path_factory):
    """Folder with the snapshot of a small hand-written estate."""
    from estate import write_snapshot
    path = str(tmp_path_factory.mktemp("snapshot"))
    write_snapshot(path)
    return path


@pytest.fixture(scope="session")
def estate(spark, snapshot_path):
    from estatescope.sources.snapshot import read_all
    return read_all(spark, snapshot_path)
