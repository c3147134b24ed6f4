import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pagegrain.session import build_session

    s = build_session("local[4]", 4, **{"spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    return s
