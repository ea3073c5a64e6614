import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(rows, cols, cur):
    """Whether Spark's rows equal those of a DuckDB result, columns and rows in any order."""
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(cols)
    a = sorted(repr(tuple(plain(r[c]) for c in sorted(cols))) for r in rows)
    b = sorted(repr(tuple(plain(r[names.index(c)]) for c in sorted(cols))) for r in cur.fetchall())
    return a == b
