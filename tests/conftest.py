import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from panelwright.session import local_session
    return local_session("8", partitions=4, memory="8g")


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
