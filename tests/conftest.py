import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for Spark's Python workers

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Compares a Spark query with its SQL, columns by name and rows in any order."""

    def plain(v):
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        return plain(v.asDict()) if hasattr(v, "asDict") else v

    def check(query, sql):
        df = query(spark, str(DATA))
        columns = sorted(df.columns)
        relation = duck.sql(sql)
        assert columns == sorted(relation.columns)
        at = [relation.columns.index(c) for c in columns]
        mine = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
        theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in relation.fetchall())
        assert mine == theirs

    return check
