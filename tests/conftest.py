import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from dialtrace.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(
        "8",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            # plan tests look for names in full
            "spark.sql.maxMetadataStringLength": "100000",
            "spark.checkpoint.dir": str(shared),
            "spark.sql.warehouse.dir": str(shared / "warehouse"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def capture(spark, sf_dir):
    from dialtrace.registry import inputs

    return inputs.capture(spark, sf_dir)


@pytest.fixture(scope="session")
def packets(spark, sf_dir):
    from dialtrace.registry import inputs

    return inputs.packets(spark, sf_dir)
