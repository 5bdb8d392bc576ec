import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tillgrid.session import build_session
    s = build_session("local[4]", 8, extra={"spark.driver.memory": "4g"})
    if not s.sparkContext.getCheckpointDir():
        # Tests only: no cluster folder is configured, so use a private scratch folder.
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tillgrid-test-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fx(spark):
    from tillgrid.sources.fixtures import ShopFixture
    return ShopFixture(spark, SF_SMALL)
