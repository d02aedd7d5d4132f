import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """Corpus from ``{path: source}`` or from sources alone."""

    def make(*sources, **named):
        rows = [(f"f{i}.py", s) for i, s in enumerate(sources)] + [
            (f"{k}.py", s) for k, s in named.items()
        ]
        return spark.createDataFrame(rows, "path string, source string")

    return make
