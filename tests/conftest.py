import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rollcall.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", 8, app="rollcall-tests")
    yield s
    s.stop()


def land(root, feed, root_key, records, day=None, name="page-0.json", raw=None):
    """Write one JSON envelope file the way the fetcher lands it."""
    folder = os.path.join(str(root), feed)
    if day is not None:
        folder = os.path.join(folder, f"reportdate={day}")
    os.makedirs(folder, exist_ok=True)
    body = raw if raw is not None else json.dumps({root_key: records}, indent=2)
    with open(os.path.join(folder, name), "w") as f:
        f.write(body)
    return folder


@pytest.fixture
def landing(tmp_path):
    return tmp_path / "landing"


@pytest.fixture
def warehouse(tmp_path):
    return str(tmp_path / "warehouse")
