"""Every query with SQL equals DuckDB on the small tables: names, types, rows."""

import duckdb
import pytest

from cohortlens.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    got = df.toPandas()
    if name not in catalog.oracle_sql():
        assert len(got) > 0
        return
    rel = db.sql(catalog.oracle_sql()[name])
    want = rel.df()
    cols = sorted(want)
    assert sorted(got) == cols
    assert {k: TYPES[v] for k, v in df.dtypes} == {k: str(v) for k, v in zip(rel.columns, rel.types, strict=True)}
    fix = lambda x: x[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert fix(got).equals(fix(want))
