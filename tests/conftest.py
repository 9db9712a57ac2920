import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from foliospark.session import build_session, ship_package

    session = build_session(8, 8, "4g")
    ship_package(session)
    yield session
    session.stop()
