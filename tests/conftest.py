import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("KARST_TEST_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.python.filterPushdown.enabled", "true").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    return SF


@pytest.fixture(scope="session")
def duck(tables):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{tables}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def same_rows(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    plain = lambda x: x[columns].astype(str).sort_values(columns).reset_index(drop=True)
    a, b = plain(a), plain(b)
    assert len(a) == len(b)
    differs = (a != b).any(axis=1)
    assert not differs.any(), f"{a[differs].head(3)}\n{b[differs].head(3)}"
