from __future__ import annotations

import glob
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Checks that a query and its SQL give the same rows, whatever their order."""

    def check(query, sql):
        got, want = query(spark, SF).toPandas(), duck.sql(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        rows = [sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist())) for df in (got, want)]
        assert rows[0] == rows[1]

    return check
