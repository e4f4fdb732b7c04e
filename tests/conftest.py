import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusflow.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a Column on one row of literals."""
    from pyspark.sql import functions as F

    def evaluate(build, *values):
        given = [v if v is not None else "" for v in values]
        df = spark.createDataFrame([tuple(given)], [f"c{i}" for i in range(len(values))])
        columns = [F.lit(None).cast("string") if v is None else F.col(f"c{i}") for i, v in enumerate(values)]
        return df.select(build(*columns).alias("v")).first()[0]

    return evaluate
