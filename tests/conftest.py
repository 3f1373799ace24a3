import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import heatsheet as hs  # noqa: E402
from checks.compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("8")
    yield spark
    hs.discard(spark)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.01"
