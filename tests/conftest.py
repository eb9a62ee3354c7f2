import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from treeline.session import session

    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.checkpoint.dir": shared, "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    return s
