import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from folioflow.session import build_session
    from folioflow.ship import ship

    session = build_session(
        "folioflow-tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture
def small_runs(spark):
    """Make every key with more than 15 rows span several runs."""
    spark.conf.set("spark.folioflow.runRows", "15")
    yield spark
    spark.conf.unset("spark.folioflow.runRows")
