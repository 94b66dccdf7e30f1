import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from faultline.cluster import local_session

    return local_session(4)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
