"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from latticeflow.queries import every

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"st5_streamed_verdicts", "st1_file_stream"}  # covered by test_streaming


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "NULL" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", [n for n in every() if n not in SLOW])
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql).fetchdf()
        assert sorted(want.columns) == sorted(got.columns)
        assert plain(want).equals(plain(got))


def test_entry(spark):
    r = entry.entry(spark).first()
    assert (r.primes, r.components, r.verdict) == (10424, 89, "SPANNING")
