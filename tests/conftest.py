import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tripfold.session import configure

    session = (
        SparkSession.builder.master("local[8]")
        .appName("tripfold-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def lookup(spark):
    from checks import stand_in
    from tripfold.sources.edges import edge_lookup

    return edge_lookup(stand_in.edges(spark))
