import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from cartlake.session import build_session  # noqa: E402




@pytest.fixture(scope="session")
def spark():
    return build_session(master="local[4]", shuffle_partitions=4, **{"spark.driver.memory": "6g"})
