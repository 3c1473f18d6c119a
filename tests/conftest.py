import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from tidewell.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", 8)
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate one column expression over a list of inputs."""

    def run(make, inputs, type_="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {type_}")
        return [r.y for r in df.select("i", make("x").alias("y")).orderBy("i").collect()]

    return run
