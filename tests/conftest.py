import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session

    s = local_session("tessera-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TESSERA_SF", "/root/testdata/sf0.001")
