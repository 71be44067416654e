import os
from pathlib import Path

import pytest
from pyspark.sql import SparkSession


#: Transports and clocks of the tests are imported by Spark's workers.
os.environ["PYTHONPATH"] = os.pathsep.join((os.environ.get("PYTHONPATH", ""), str(Path(__file__).resolve().parent)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
