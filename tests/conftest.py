import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sparkloom.session import session

    return session("tests", cores=4, **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-"), "spark.ui.enabled": "false"})


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
