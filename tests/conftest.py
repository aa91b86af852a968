from __future__ import annotations

import datetime as dt
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from eventlab.session import build_session  # noqa: E402

SMALL_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("eventlab-tests", min(8, os.cpu_count() or 4))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    return SMALL_DIR


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def rows(df, *order):
    """The rows as tuples, sorted by the named columns."""
    return [tuple(r) for r in df.orderBy(*order).collect()]
