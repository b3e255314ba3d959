import pytest

from tidemark.runtime import session, shared_dir


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    out = session("tests", cores="4", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    out.sparkContext.setLogLevel("ERROR")
    shared_dir(out)
    return out


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
