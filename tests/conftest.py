import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from factorloom.session import session

    s = session("local[4]", spark_ui_enabled="false", spark_sql_shuffle_partitions="6", spark_driver_memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    return s
