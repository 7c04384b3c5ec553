import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def lines(spark):
    """Makes a table of lines of one source out of texts."""

    def make(texts, source="s"):
        rows = [(source, i, text) for i, text in enumerate(texts)]
        return spark.createDataFrame(rows, "source string, line_id bigint, value string")

    return make


@pytest.fixture
def sample_logs(spark):
    start = datetime(2025, 3, 2, 7, 0)
    levels = ["INFO", "ERROR", "WARNING", "ERROR", "INFO", "ERROR", "DEBUG"]
    modules = ["api", "db", "api", "db", "cache", "api", "db"]
    rows = [
        (start + timedelta(minutes=10 * i), level, module, f"{level} in {module} #{i}", f"10.1.0.{i}")
        for i, (level, module) in enumerate(zip(levels, modules))
    ]
    return spark.createDataFrame(
        rows, "timestamp timestamp, level string, module string, message string, ip string"
    )
