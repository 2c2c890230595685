import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from trendscope.session import get_session
    s = get_session(master="local[4]", shuffle_partitions=8,
                    extra={"spark.ui.showConsoleProgress": "false"})
    yield s


@pytest.fixture(scope="session")
def duck_small():
    from tests.oracle_compare import duck
    return duck(SF_SMALL)


@pytest.fixture(scope="session")
def tables_small(spark):
    from trendscope.plans.catalog import Tables
    return Tables(spark, SF_SMALL)


@pytest.fixture(scope="session")
def tables_mid(spark):
    from trendscope.plans.catalog import Tables
    return Tables(spark, SF_MID)
