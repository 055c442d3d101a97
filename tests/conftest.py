"""One local session for all tests."""

import sys
from functools import lru_cache
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SF = "/root/testdata/sf0.001"


@lru_cache(maxsize=1)
def session():
    from pyspark.sql import SparkSession

    own = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    own.sparkContext.setLogLevel("ERROR")
    from veldt.session import ship

    ship(own)
    return own


def pytest_sessionstart():
    session()  # columns can be made while tests are collected


@pytest.fixture(scope="session")
def spark():
    yield session()
    session().stop()
