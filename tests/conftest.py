"""One small session for all tests."""

import os

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

import pytest

from docketry.session import build


@pytest.fixture(scope="session")
def spark():
    session = build("local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="3g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
