"""One Spark session for all tests, and the tables that they run over."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    at = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(at / "shared")).config("spark.sql.warehouse.dir", str(at / "warehouse")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return DATA


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


@pytest.fixture(scope="session")
def same_as_sql():
    """A check that a DataFrame has the rows of a DuckDB statement, over the test tables or over given ones."""

    def check(df, sql, tables=None):
        con = duckdb.connect()
        con.execute("SET timezone = 'UTC'")
        for name, source in (tables or {t: f"{DATA}/{t}.parquet" for t in TABLES}).items():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
        got = con.execute(sql)
        names = [c[0] for c in got.description]
        want = got.fetchall()
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        rows = [tuple(_plain(r[c]) for c in order) for r in df.collect()]
        assert sorted(rows, key=repr) == sorted((tuple(_plain(r[names.index(c)]) for c in order) for r in want), key=repr)

    return check
