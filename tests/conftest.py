import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cashtrail.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def small_tasks(spark):
    """Force the chunked plans: a task may hold few rows of a key."""
    def use(rows: int, fold: int = 20):
        spark.conf.set("cashtrail.maxRowsPerTask", str(rows))
        spark.conf.set("cashtrail.maxRowsPerFold", str(fold))
    yield use
    spark.conf.unset("cashtrail.maxRowsPerTask")
    spark.conf.unset("cashtrail.maxRowsPerFold")
