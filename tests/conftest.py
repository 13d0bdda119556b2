import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from telemill import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    built = session.build(
        "telemill-tests",
        **{
            "spark.master": "local[8]",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
        },
    )
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()
