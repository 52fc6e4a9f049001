from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dealgrid.plans.sizing import cleanup  # noqa: E402
from dealgrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="*", shuffle_partitions=8)
    # a stage whose generated code does not compile must fail the test, not
    # silently fall back to interpreted evaluation
    s.conf.set("spark.sql.codegen.fallback", "false")
    yield s
    cleanup(s)


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
