from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from opslens.session import RECOMMENDED_CONF, ensure_checkpoint_dir

    builder = (SparkSession.builder.master("local[*]").appName("opslens-tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def snap_small(spark):
    from opslens.sources.fixtures import Snapshot
    return Snapshot(spark, SF_SMALL)


@pytest.fixture(scope="session")
def duck_small():
    from opslens.plans.compare import duckdb_connection
    return duckdb_connection(SF_SMALL)


@pytest.fixture(scope="session")
def duck_mid():
    from opslens.plans.compare import duckdb_connection
    return duckdb_connection(SF_MID)
