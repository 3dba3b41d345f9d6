import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for p in (ROOT, os.path.join(ROOT, "tests")):
    if p not in sys.path:
        sys.path.insert(0, p)


@pytest.fixture(scope="session")
def spark():
    from trendlens.session import local_session, shared_dir

    s = local_session(4, app="trendlens-tests", **{"spark.sql.shuffle.partitions": "8"})
    shared_dir(s)
    yield s
    s.stop()
