import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from strandline.session import local_session

    s = local_session(8, 4)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('shared')}")
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Sorted rows of a DataFrame as tuples."""
    return lambda df, *cols: sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)
