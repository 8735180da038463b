import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from anchorline.session import local_session
    s = local_session("tests", cpus=8, memory="8g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
