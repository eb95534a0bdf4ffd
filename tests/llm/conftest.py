import pytest

from fleetgauge.llm.common import shipped


@pytest.fixture(scope="session")
def spark(spark):
    return shipped(spark)


@pytest.fixture
def frame(spark):
    """Rows as a DataFrame, with columns added whose names operators use inside."""

    def make(rows, schema):
        df = spark.createDataFrame(rows, schema)
        from pyspark.sql import functions as F

        taken = {name.lower() for name in df.columns}
        inner = ["row", "d", "t", "id", "bands", "kept", "hub", "score", "length", "a", "b"]
        return df.withColumns({n: F.lit(f"own {n}") for n in inner if n not in taken})

    return make
