import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from kpiloom.session import configure, ensure_checkpoint_dir

    s = (SparkSession.builder.master("local[*]").appName("kpiloom-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def duck_small():
    from kpiloom.plans.verify import duck_connect

    return duck_connect(SF_SMALL)
