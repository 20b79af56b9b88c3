from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from panelmill import session

    shared = str(tmp_path_factory.mktemp("shared"))
    s = session.build("tests", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8", spark__checkpoint__dir=shared, spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import oracle

    return oracle.connect(SF)


@pytest.fixture(scope="session")
def sf():
    return SF
