from __future__ import annotations

import pytest

from tallyweave.plans.session import session, ship


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
