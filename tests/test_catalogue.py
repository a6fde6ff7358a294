import os

import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(row):
    return tuple(None if v is None or v is pd.NA or v != v else v if isinstance(v, (str, bool)) or hasattr(v, "year") else round(float(v), 5) for v in row)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith(("q_", "x_"))])
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine = entry.queries()[name](spark, SF).toPandas()
    theirs = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    theirs = theirs[list(mine.columns)]
    key = lambda r: repr(r)
    assert sorted(map(plain, mine.itertuples(index=False)), key=key) == sorted(map(plain, theirs.itertuples(index=False)), key=key)
