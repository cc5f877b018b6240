import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))


@pytest.fixture(scope="session")
def spark():
    from ragchew.session import get_spark
    s = get_spark("local[8]", shuffle_partitions=4, app_name="ragchew-tests")
    yield s


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"
