import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from mixedframe.session import drop_staged, local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    yield session
    drop_staged(session)
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    if not Path(DATA).is_dir():
        pytest.skip("driver tables are not on this machine")
    return DATA
