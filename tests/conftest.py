import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tapewatch.session import build_session

    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "5",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.driver.host": "localhost",
            # keep several partitions on small data, so that what is carried between them is exercised
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["plain", "large"])
def group_rows(request, spark):
    """Once with every group in one task, once with every group above eight rows cut up."""
    spark.conf.set("tapewatch.groupRows", "2000000" if request.param == "plain" else "8")
    yield request.param
    spark.conf.unset("tapewatch.groupRows")
