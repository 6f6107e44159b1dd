import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from hearthmap.session import local_session

    folders = {
        "spark__checkpoint__dir": str(tmp_path_factory.mktemp("checkpoint")),
        "spark__sql__warehouse__dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    session = local_session("8", spark__sql__shuffle__partitions="4", **folders)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


def table(df, *columns, digits=9):
    """Rows as a sorted list of tuples, floats rounded, NULL first."""
    def cell(v):
        return round(v, digits) if isinstance(v, float) else v

    rows = [tuple(cell(r[c]) for c in columns) for r in df.collect()]
    return sorted(rows, key=lambda r: [(v is not None, v) for v in r])
