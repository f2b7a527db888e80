import os
import sys

import numpy as np
import pandas as pd
import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def cloud_arrays():
    """A sloping field with canopy, 3000 points on 60 x 60."""
    rng = np.random.default_rng(42)
    n = 3000
    x, y = rng.uniform(0, 60, n), rng.uniform(0, 60, n)
    ground = rng.random(n) < 0.7
    z = 250 + 0.05 * x + 0.03 * y + 2.5 * np.sin(x / 15) + np.where(ground, rng.normal(0, 0.05, n), rng.uniform(2, 12, n))
    return {
        "pid": np.arange(n), "x": 500000 + np.round(x, 3), "y": 5200000 + np.round(y, 3), "z": np.round(z, 3),
        "classification": np.where(ground, 2, 5).astype(np.int32), "return_number": rng.integers(1, 3, n).astype(np.int32),
        "intensity": rng.integers(1000, 15000, n).astype(np.int32), "red": rng.integers(0, 55000, n).astype(np.int32), "green": rng.integers(0, 55000, n).astype(np.int32), "blue": rng.integers(0, 55000, n).astype(np.int32),
    }


@pytest.fixture(scope="session")
def cloud(spark, cloud_arrays):
    return spark.createDataFrame(pd.DataFrame(cloud_arrays)).cache()
