import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import session

    shared = tmp_path_factory.mktemp("shared")
    s = session("local[4]", 4, spark_checkpoint_dir=str(shared), spark_driver_memory="4g", spark_sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")))
    yield s
    s.stop()
