import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lumen.session import build_session
    s = build_session("local[4]", app="lumen-tests", shuffle_partitions=8,
                      extra={"spark.driver.memory": "4g"})
    # Tests have no cluster-named shared folder; give them their own.
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumen-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def employees(spark):
    """Invented rows shaped like the reference's sample: 7 rows, 2 exact
    duplicates, one missing Age, two missing Salary (in the duplicated pair)."""
    rows = [(1, "Ann", 22.0, 50000.0, "US"),
            (2, "Bob", 24.0, 52000.0, "UK"),
            (3, "Cid", 45.0, 98000.0, "US"),
            (4, "Dee", 22.0, None, "DE"),
            (4, "Dee", 22.0, None, "DE"),
            (5, "Eve", None, 61000.0, "US"),
            (6, "Fay", 32.0, 70000.0, "FR")]
    return spark.createDataFrame(rows, "User_ID long, Name string, Age double, Salary double, Country string")


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="lumen-test-")
