import tempfile

import pytest
from pyspark.sql import SparkSession

from lakemill.session import SETTINGS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
    builder = builder.config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='lakemill-tests-')}").config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="lakemill-warehouse-"))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    made = builder.getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
