import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from mdloom.session import local_session, ship_package
    s = local_session(shuffle_partitions=8, app="mdloom-tests")
    ship_package(s)
    yield s
    s.stop()


def one_col(spark, col_expr, values, schema):
    """Evaluate a Column expression over an inline table; returns list of results."""
    df = spark.createDataFrame(values, schema)
    return [r[0] for r in df.select(col_expr).collect()]
