import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[8]").appName("tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
         .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def points(spark):
    """DataFrame (id, features) from a numpy matrix."""
    def make(x, start=0):
        rows = [(start + i, [None if v != v else float(v) for v in r]) for i, r in enumerate(x)]
        return spark.createDataFrame(rows, "id long, features array<double>").repartition(4)
    return make
