from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from quagmark.session import session

    s = session("tests", cores=4, spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
