"""Every registered query of the reference's operators against its SQL on the smallest tables."""

import decimal

import duckdb
import pytest

from sievemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in names]).collect()), key=repr)
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == names
    want = sorted((tuple(plain(x) for x in r) for r in rel.select(*[f'"{c}"' for c in names]).fetchall()), key=repr)
    assert got == want
    if name.startswith("det"):
        assert got or name == "det35_dictionary" or name == "det36_custom_regex"
