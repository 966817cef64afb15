import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlink.session import build_session, checkpoint_dir  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", app="ledgerlink-tests", shuffle_partitions=8)
    checkpoint_dir(s)  # unset in tests: a private folder is created and set
    yield s
    s.stop()


@pytest.fixture(scope="session")
def seed(spark):
    from ledgerlink.sources.master import seed_master

    return seed_master(spark)
