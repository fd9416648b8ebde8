from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from agorametrics.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.maxMetadataValueLength", "10000").config("spark.sql.debug.maxToStringFields", "500")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def table(spark):
    """Rows and a schema string to a frame; timestamps as text are cast."""

    def make(rows, schema):
        stamps = [c.split()[0] for c in schema.split(",") if c.strip().endswith(" timestamp")]
        df = spark.createDataFrame(rows, ", ".join(
            c.replace(" timestamp", " string") if c.split()[0] in stamps else c for c in schema.split(",")))
        return df.withColumns({c: df[c].cast("timestamp") for c in stamps}) if stamps else df

    return make
