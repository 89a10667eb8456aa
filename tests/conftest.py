import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from docketry.session import session

    return session("tests", cpus=4, partitions=4)


@pytest.fixture(scope="session")
def sf_dir():
    return DATA
