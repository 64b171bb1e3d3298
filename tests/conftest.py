import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from tablewright.session import DEFAULT_CONF, LOCAL_CONF
    b = (SparkSession.builder.master("local[*]").appName("tablewright-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g"))
    for k, v in {**DEFAULT_CONF, **LOCAL_CONF}.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    # tests only: no shared checkpoint folder is configured here
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tw-test-ckpt-"))
    yield s
