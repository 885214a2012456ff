import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quarry.session import ensure_checkpoint_dir, local_session

    # one JVM runs every test's queries: give it a realistic heap (default 1g)
    s = local_session("*", 8, app="quarry-tests", extra={"spark.driver.memory": "8g"})
    ensure_checkpoint_dir(s, fallback=tempfile.mkdtemp(prefix="quarry-test-ckpt-"))
    yield s
    s.stop()
