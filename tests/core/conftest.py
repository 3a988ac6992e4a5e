import pytest


@pytest.fixture
def col(spark):
    """Value of a column expression over named values."""

    def value(build, **values):
        kinds = {str: "string", int: "int", float: "double", bool: "boolean", list: "array<string>", type(None): "string"}
        schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
        return spark.createDataFrame([tuple(values.values())], schema).select(build.alias("x")).first().x

    return value
