import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from newsloom.session import local_session  # noqa: E402

ARCHIVE = os.environ.get("ARCHIVE_DIR", "")
TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


# Columns are built at import time in some tests, which needs a session.
SESSION = local_session("8", 4, "8g")
SESSION.sparkContext.setLogLevel("OFF")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def archive():
    if not os.path.isdir(f"{ARCHIVE}/raw"):
        pytest.skip("no archive files here")
    return ARCHIVE
