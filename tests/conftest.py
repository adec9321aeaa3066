import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from strandline.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    built = session("tests", "local[8]", **{
        "spark__sql__shuffle__partitions": "8", "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false", "spark__driver__memory": "8g"})
    built.sparkContext.setLogLevel("ERROR")
    return built
