import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from blastradius.session import local_session  # noqa: E402
from blastradius.workspace import Workspace  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests")


@pytest.fixture()
def ws(spark):
    space = Workspace(spark)
    yield space
    space.drop()
