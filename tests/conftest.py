import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from partylens.session import local_session

    session = local_session(4, "4g", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared"))})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables here")
    return str(folder)
