import pytest
from pyspark.sql import SparkSession

from tests.sessions import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    return session(str(tmp_path_factory.mktemp("checkpoints")), str(tmp_path_factory.mktemp("warehouse")))
