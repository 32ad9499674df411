import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loomfield.session import get_session

    session = get_session(cores=4, app="loomfield-tests", shuffle_partitions=4, memory="6g")
    if not session.conf.get("spark.checkpoint.dir", ""):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()
