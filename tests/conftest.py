import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from shopstream.session import checkpoint_dir, get_spark
    s = get_spark(app="shopstream-tests", master="local[*]", shuffle_partitions=8,
                  extra={"spark.driver.memory": "4g",
                         "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="shopstream-wh-")})
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)  # sets a scratch folder only when the session has none
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="shopstream-test-")


SF_SMALL = "/root/testdata/sf0.001"
