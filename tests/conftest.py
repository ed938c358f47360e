import os

import pytest

from vidlake.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("checkpoints"))
    session = local_session(os.environ.get("TEST_CPUS", "4"), **{"spark.checkpoint.dir": f"file://{folder}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setCheckpointDir(f"file://{folder}")
    yield session
    session.stop()
