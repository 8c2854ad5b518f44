import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("TEST_DATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """Rows of a SQL query over a folder's tables, columns by name, sorted as text."""

    def run(sql, sf="sf0.001"):
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{DATA}/{sf}/{t}.parquet'")
        got = con.sql(sql)
        order = sorted(range(len(got.columns)), key=got.columns.__getitem__)
        return [got.columns[i] for i in order], sorted([tuple(r[i] for i in order) for r in got.fetchall()], key=repr)

    return run


@pytest.fixture(scope="session")
def rows_of():
    """Rows of a DataFrame in the same form."""

    def run(df):
        names = sorted(df.columns)
        return names, sorted([tuple(r) for r in df.select(*names).collect()], key=repr)

    return run
