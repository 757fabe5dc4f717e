from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tablero.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    from tablero.sources.testdata import tables_from_testdata

    return tables_from_testdata(spark, SMALL)
