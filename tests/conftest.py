from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (HERE, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    place = tmp_path_factory.mktemp("spark")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.warehouse.dir": f"{place}/warehouse", "spark.checkpoint.dir": f"{place}/checkpoints", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}
    out = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()
