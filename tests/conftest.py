import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from kymora.session import local_session

    s = local_session(8)
    yield s
    s.stop()


def rows(df, *order):
    """Rows as tuples, sorted by the given columns (or by all)."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((v is None, v) for v in r))
