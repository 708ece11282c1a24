import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from voxelgraph.session import local_session

    session = local_session("tests", cpus="8", partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    return session
