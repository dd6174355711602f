"""Every query of the library against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from linemetry.plans import measuring, queries as q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df: pd.DataFrame) -> list:
    cell = lambda v: None if v is None or v is pd.NA or v != v else (round(float(v), 5) if isinstance(v, float) else str(v))
    columns = sorted(df.columns)
    return sorted(([cell(v) for v in row] for row in df[columns].itertuples(index=False)), key=str)


def test_all_are_registered():
    assert measuring.perpendicular_widths in q.QUERIES.values()


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, name):
    found = q.QUERIES[name](spark, DATA).toPandas()
    assert len(found)
    if name in q.ORACLE:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        assert canonical(found) == canonical(con.sql(q.ORACLE[name]).df())
