from __future__ import annotations

import os

import pytest
from pyspark.sql import SparkSession

os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("cohortkit-tests")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def respondents(spark, sf):
    """Analytic table of the small survey, cached."""
    from catalog.queries import analytic

    df = analytic(spark, sf).persist()
    df.count()
    return df
