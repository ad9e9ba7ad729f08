import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from terraledger.session import local_session

    s = local_session(4, 4, "4g")
    s.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    yield s
    s.stop()
