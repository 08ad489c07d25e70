from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from readloom.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark(4, 4, spark__driver__memory="4g", spark__sql__files__maxPartitionBytes="4m")
    s.sparkContext.setLogLevel("ERROR")
    yield s
