import glob
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(table, columns):
    """Order-free text form of rows, floats to nine digits."""
    show = lambda x: "" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[c]) for c in columns) for r in table)


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(name, query, sql):
        df = query(spark, DATA)
        got = [r.asDict() for r in df.collect()]
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
        assert sorted(df.columns) == sorted(names), name
        assert rows(got, sorted(names)) == rows(want, sorted(names)), name

    return check
