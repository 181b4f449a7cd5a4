import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from runsift.operators import blocks  # noqa: E402
from runsift.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "3")
    # Tiny inputs: re-planning after every stage would be most of the time.
    session.conf.set("spark.sql.adaptive.enabled", "false")
    return session


@pytest.fixture
def small_blocks(monkeypatch):
    """Three lines per block, so that short logs cross many block borders."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 3)


@pytest.fixture
def log(spark):
    def build(logs):
        rows = [(e, i, line) for e, lines in logs.items() for i, line in enumerate(lines)]
        return spark.createDataFrame(rows, "exec_id string, line_no bigint, line string")

    return build
