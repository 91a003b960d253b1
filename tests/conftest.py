import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(folder))
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def table(spark, data):
    return lambda name: spark.read.parquet(f"{data}/{name}.parquet")


@pytest.fixture(scope="session")
def make(spark, table):
    """Rows of a table of the data model, given by some of their columns; the others are null."""

    def build(name, *rows):
        schema = table(name).schema
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)

    return build


@pytest.fixture(scope="session")
def clash():
    """Adds columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    def add(df):
        return df.withColumns({c: F.lit("x") for c in ("n", "kind", "run", "utc_us", "_c", "_days", "id", "grp", "key", "items", "word", "label", "labels", "bucket", "entity", "position") if c not in df.columns})

    return add
