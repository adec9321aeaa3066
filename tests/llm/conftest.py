import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture
def shared(spark, tmp_path):
    """A folder for checkpoints of one test."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    return tmp_path
