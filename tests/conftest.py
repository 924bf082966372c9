import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # the workers import the package too


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from fabula.session import build_session

    top = tmp_path_factory.mktemp("spark")
    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g", "spark.sql.warehouse.dir": str(top / "warehouse"), "spark.checkpoint.dir": str(top / "shared")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
