import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pathlens.session import build_session
    base = tempfile.mkdtemp(prefix="pathlens-tests-")
    s = build_session("local[4]", app="pathlens-tests", shuffle_partitions=4,
                      **{"spark.ui.enabled": "false",
                         "spark.sql.warehouse.dir": os.path.join(base, "warehouse"),
                         "spark.checkpoint.dir": os.path.join(base, "checkpoints")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="pathlens-t-")


def ts(text):
    import datetime as dt
    return dt.datetime.fromisoformat(text)
