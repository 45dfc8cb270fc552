import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera import session

    made = session.build(
        "local[4]",
        spark_sql_shuffle_partitions="4",
        spark_ui_enabled="false",
        spark_driver_memory="4g",
        spark_sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    made.conf.set("spark.sql.shuffle.partitions", "4")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
