import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from sieveline.session import local

    return local(4, "4g", "tests")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
