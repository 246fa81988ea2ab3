import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from larderline.session import build_session, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "larderline-tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


def rows(df, *order):
    """Rows as plain tuples, in key order."""
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else sorted(
        (tuple(r) for r in df.collect()), key=repr
    )
