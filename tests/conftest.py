import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wiretally.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "wiretally-tests", **{"spark.sql.shuffle.partitions": "4",
                                               "spark.sql.session.timeZone": "UTC"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
