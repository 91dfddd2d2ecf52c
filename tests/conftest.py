import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import compare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return compare.session(4)


@pytest.fixture(scope="session")
def duck():
    return compare.duck(SF)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF
