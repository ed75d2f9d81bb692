"""Every query with SQL agrees with it, as sets of rows with their counts."""
from collections import Counter

import duckdb
import pytest

from tidewatch import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    d = duckdb.connect()
    for t in "events orders nation customer supplier part".split():
        d.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return d


def rounded(rows):
    return Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    want = db.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert rounded(got.select(*[f"`{c}`" for c in cols]).collect()) == rounded(want.select(*[f'"{c}"' for c in cols]).fetchall())
