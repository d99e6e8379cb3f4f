import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
ROOT = os.path.dirname(HERE)
sys.path.insert(0, ROOT)
# test modules define small backends; workers must import them by module name
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, ROOT, os.environ.get("PYTHONPATH", "")])

from veracity.session import get_spark  # noqa: E402

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return get_spark(master="local[*]", shuffle_partitions=8)
