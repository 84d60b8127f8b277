import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tideline.session import build_session

    return build_session("tests", "4", "6g")


@pytest.fixture(scope="session")
def root():
    return "/root/testdata/sf0.001"
