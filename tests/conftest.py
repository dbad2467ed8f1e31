import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from rewardframe.session import local_session

    session = local_session(8, "rewardframe-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over one row of named texts."""

    def run(expr, **texts):
        names = list(texts) or ["_"]
        schema = ", ".join(f"{n} {'array<string>' if isinstance(texts.get(n), list) else 'string'}" for n in names)
        df = spark.createDataFrame([tuple(texts.get(n) for n in names)], schema)
        return df.select(expr().alias("v")).first()["v"]

    return run
