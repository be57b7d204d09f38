"""Every query with SQL gives the SQL's rows."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    show = lambda df: sorted("|".join(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))
    a, b = show(got), show(want)
    assert len(a) == len(b) and a == b, (a[:3], b[:3])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
