import pytest

from checks.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session()
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return session
