import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from curatrix.session import get_spark

    session = get_spark("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def one(spark, column, schema=None, **values):
    """A column's value over one literal row."""
    from pyspark.sql import functions as F

    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("out")).first()["out"]
