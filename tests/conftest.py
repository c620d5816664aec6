import pytest

from runlens.plans.check import session
from runlens.session import tune


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = tune(session("4", 2))
    # Tiny inputs: interpreting the plans is much faster than compiling them.
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    yield spark
    spark.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression for one row of given values."""

    def value(expression, **columns):
        names = list(columns) or ["x"]
        kinds = {str: "string", float: "double", int: "bigint", type(None): "string"}
        schema = ", ".join(f"{n} {kinds[type(columns.get(n, 0))]}" for n in names)
        return spark.createDataFrame([tuple(columns.get(n, 0) for n in names)], schema).select(expression.alias("v")).first()["v"]

    return value


@pytest.fixture
def many(spark):
    """Values of a column expression over a list of inputs, in order."""

    def values(make, inputs, kind="string"):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
        return [r["v"] for r in rows.select("i", make(F.col("x")).alias("v")).orderBy("i").collect()]

    return values
