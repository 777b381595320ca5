import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from pyspark import cloudpickle  # noqa: E402

import gradeloom  # noqa: E402
import workload  # noqa: E402

cloudpickle.register_pickle_by_value(gradeloom)
cloudpickle.register_pickle_by_value(workload)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = gradeloom.build_session(
        "tests",
        master="local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *order):
    """Rows as dicts, in the given order."""
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]


def one(df):
    return rows(df)[0]
