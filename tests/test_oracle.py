"""Every registered query of the library's own operators against DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from arrayloom.plans import catalogue

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, sf_dir, duck):
    df = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert sorted(names) == columns
    assert {c: KINDS.get(k, k) for c, k in df.dtypes} == kinds
    assert got == sorted(str(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())


def test_logs_of_missing_values(spark, tmp_path):
    """A missing value isn't greater than 0 nor 0: NaN, as the SQL has it, and never NULL; NaN and infinities as they are."""
    values = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, -5.5, 0.1, 8.0, 5e-324]
    spark.createDataFrame([(n, v) for n, v in enumerate(values * 11)], "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.queries()["elementwise_logs"](spark, str(tmp_path)).orderBy("event_id").collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.execute(catalogue.oracle_sql()["elementwise_logs"] + " ORDER BY event_id").fetchall()
    assert [str(tuple(r)) for r in got] == [str(r) for r in want]
