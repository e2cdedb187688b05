import os

import pytest
from pyspark.sql import SparkSession

from fleetscope.operators import ordered
from fleetscope.session import configure

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (configure(SparkSession.builder.master("local[8]").appName("tests"))
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "4g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiny_groups(monkeypatch):
    """Slices of single whole numbers, so that small data has many."""
    monkeypatch.setattr(ordered, "BLOCK_BITS", 0)
    monkeypatch.setattr(ordered, "CELLS", 4096)


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA
