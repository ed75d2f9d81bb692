"""Every query with SQL agrees with it."""
import duckdb
import pytest

from tidewatch.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF), db.sql(registry.oracle_sql()[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want.select(*[f'"{c}"' for c in cols]).fetchall()))
