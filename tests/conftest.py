import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from docloom.session import session

    found = session(cores=4, partitions=4, memory="4g")
    yield found
    found.stop()
