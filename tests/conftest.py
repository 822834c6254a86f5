import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[8]").appName("tests")
         .config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
         .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def long_frame(spark):
    """Build a long table from {id: values}; days are 1..n, None is missing."""

    def make(series, days=None):
        rows = []
        for k, vs in series.items():
            ds = (days or {}).get(k, range(1, len(vs) + 1))
            rows += [(k, None if d is None else float(d), None if v is None else float(v)) for d, v in zip(ds, vs)]
        return spark.createDataFrame(rows, "id string, day double, v double")

    return make
