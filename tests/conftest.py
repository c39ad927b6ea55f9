import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from corpusbrief.session import get_session

    s = get_session("local[4]", app_name="corpusbrief-tests", shuffle_partitions=8,
                    extra_conf={"spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="cb-test-", dir=os.environ.get("TMPDIR", "/tmp"))


SF = "/root/testdata/sf0.001"
