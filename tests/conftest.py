import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from cairn.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "cairn-tests")
    session.conf.set("spark.sql.shuffle.partitions", "8")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def stand(spark):
    from cairn.plans.stand_ins import StandIns

    return StandIns(spark, DATA)
