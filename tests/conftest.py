import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from ramify.session import get_spark, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "ramify-tests",
        master="local[8]",
        spark_sql_shuffle_partitions="8",
        spark_ui_enabled="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()
