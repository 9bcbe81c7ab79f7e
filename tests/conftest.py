import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def numbered(spark):
    """Text lines as a DataFrame with an integer ``line_no``."""

    def make(lines):
        rows = [(i, line if isinstance(line, bytes) else line.encode()) for i, line in enumerate(lines)]
        return spark.createDataFrame(rows, "line_no bigint, raw binary").selectExpr(
            "line_no", "cast(raw as string) as value"
        )

    return make
