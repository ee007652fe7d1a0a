import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def norm(v):
    return round(v, 6) if isinstance(v, float) else [norm(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def same():
    """Compares a query with its SQL in DuckDB, rows in any order."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")

    def compare(df, sql):
        cols = sorted(df.columns)
        got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
        cur = con.execute(sql)
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        want = sorted(repr([norm(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
        assert got == want

    return compare
