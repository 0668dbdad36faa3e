"""Every query of these operators that has SQL equals DuckDB on the small tables: names, types, rows."""

import duckdb
import pytest

from cohortlens.llm import registry

SF = "/root/testdata/sf0.001"
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, rel = registry.queries()[name](spark, SF), db.sql(registry.oracle_sql()[name])
    assert {k: TYPES[v] for k, v in df.dtypes} == {k: str(v) for k, v in zip(rel.columns, rel.types, strict=True)}
    cols = sorted(df.columns)
    fix = lambda x: x[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert fix(df.toPandas()).equals(fix(rel.df()))
