import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from loanlag.session import local_session

    scratch = tempfile.mkdtemp(prefix="loanlag-tests-")
    session = local_session("*", shuffle_partitions=8,
                            checkpoint_dir=os.path.join(scratch, "checkpoints"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from loanlag.sources import load_fixture

    return load_fixture(spark, SF001)


@pytest.fixture(scope="session")
def duck():
    from tests.oracle import duck_connection

    return duck_connection(SF001)
