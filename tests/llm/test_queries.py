import glob
import os

import duckdb
import pytest

from marlstone.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    order = sorted(want.columns)
    one = lambda v: None if v is None or v != v else str(int(v)) if isinstance(v, float) else str(v)
    rows = lambda df: sorted(str([one(v) for v in r]) for r in df[order].astype(object).where(df[order].notna(), None).itertuples(index=False, name=None))
    assert sorted(got.columns) == order and rows(got) == rows(want)
