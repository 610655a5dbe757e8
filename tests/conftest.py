import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from tidelog import registry  # noqa: E402
from tidelog.session import build_session  # noqa: E402

registry.load_all()

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", 8, "tidelog-tests", {"spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false",
         "spark.sql.maxMetadataStringLength": "2000"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
