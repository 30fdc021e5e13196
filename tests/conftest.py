import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from canasta.session import get_session

    session = get_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
