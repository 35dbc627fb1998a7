import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tilewright-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return c


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return str(v) if isinstance(v, (list, dict)) else v


@pytest.fixture(scope="session")
def same(duck):
    """Whether a DataFrame's rows are those of an SQL text, whatever their order."""

    def check(df, sql):
        columns = sorted(df.columns)
        got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=str)
        rel = duck.sql(sql)
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert got == sorted((tuple(_plain(r[k]) for k in at) for r in rel.fetchall()), key=str)

    return check
