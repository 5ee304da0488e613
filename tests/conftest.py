import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from matchlab.session import checkpoint_dir, local_session
    s = local_session("*", 8, app="matchlab-tests")
    checkpoint_dir(s)  # tests: a scratch folder only because none is configured
    yield s
