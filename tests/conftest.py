"""One local session for all tests."""

import os
import sys

import pytest
from pyspark.sql import SparkSession

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def odd_tables(spark, tmp_path_factory):
    """Folders with all tables empty, and with three rows of nulls each."""
    from pathlib import Path

    source = sorted(Path("/root/testdata/sf0.001").glob("*.parquet"))
    if not source:
        pytest.skip("no test data")
    empty, nulls = (tmp_path_factory.mktemp(x) for x in ("empty", "nulls"))
    for f in source:
        schema = spark.read.parquet(str(f)).schema
        spark.createDataFrame([], schema).write.parquet(str(empty / f.name))
        spark.createDataFrame([(None,) * len(schema)] * 3, schema).write.parquet(str(nulls / f.name))
    return str(empty), str(nulls)
