import os
import sys
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def daily(n_pre=1095, n_post=365, effect=0.0, seed=0, noise=5.0):
    """A daily series with a trend and a yearly season, and its event."""
    rng = np.random.default_rng(seed)
    n = n_pre + n_post
    t = np.arange(n)
    y = 100 + 0.01 * t + 10 * np.sin(2 * np.pi * t / 365) + rng.normal(0, noise, n)
    y[n_pre:] += effect
    ds = pd.date_range("2018-01-01", periods=n)
    return pd.DataFrame({"ds": ds, "y": y}), ds[n_pre] if n_post else None


def long(spark, pdf, series="s"):
    df = spark.createDataFrame(pdf)
    from counterspark.sources.series import ingest

    return ingest(df).withColumn("series_id", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(series))


@pytest.fixture(autouse=True)
def quiet():
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)
        yield
