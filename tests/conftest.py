import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sheaf.session import local_session

    s = local_session(cores="4", shuffle_partitions=8, app="sheaf-tests")
    yield s
    s.stop()


@pytest.fixture
def textfile(tmp_path):
    """Write literal fixture content to a file and return its path."""
    counter = {"n": 0}

    def make(content: str, name: str | None = None) -> str:
        counter["n"] += 1
        p = tmp_path / (name or f"f{counter['n']}.csv")
        p.write_text(content)
        return str(p)

    return make


def rows(w):
    """All data rows, in row order, as lists."""
    return [list(r) for r in w.ordered_df(with_part=False).collect()]
