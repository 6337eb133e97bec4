import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from quellgraph.runtime import get_session

    s = get_session("tests", "local[8]", **{k: v for k, v in {"spark_ui_enabled": "false", "spark_sql_shuffle_partitions": "4", "spark_driver_memory": "4g", "spark_ui_showConsoleProgress": "false"}.items()})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def small():
    """The smallest of the driver's data; tests on it are left out where it isn't there."""
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no test data here")
    return str(path)


def rows(df, *cols):
    return {tuple(r) for r in (df.select(*cols) if cols else df).collect()}
