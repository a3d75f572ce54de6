import os

import pytest

from loomspark.runtime import session


@pytest.fixture(scope="session")
def spark():
    s = session(
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.log.level": "ERROR", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"},
    )
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return os.environ.get("LOOMSPARK_TEST_DATA", "/root/testdata/sf0.001")
