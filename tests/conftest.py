import os
import sys

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
os.environ.setdefault("OMP_NUM_THREADS", "1")

import pytest  # noqa: E402

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from attraudit.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
