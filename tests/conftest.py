import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from serploom.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def one(spark):
    """Evaluates a column expression over one row of string inputs."""
    from pyspark.sql import functions as F

    def run(build, *values):
        row = spark.range(1).select(*[F.lit(v).cast("string").alias(f"c{i}") for i, v in enumerate(values)])
        return row.select(build(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]

    return run


@pytest.fixture(scope="session")
def many(spark):
    """Evaluates a column expression over a list of strings."""
    from pyspark.sql import functions as F

    def run(build, values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        return [r["x"] for r in df.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]

    return run
