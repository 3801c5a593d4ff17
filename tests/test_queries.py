"""Every registered query against its SQL in another engine, over the smallest stand-in tables."""

import duckdb
import pytest

from lotlens.plans import queries as q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


def plain(value):
    return repr(round(value, 9) + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    found = q.QUERIES[name](spark, DATA)
    rows = found.collect()
    if name not in q.ORACLE_SQL:
        return
    want = duck.execute(q.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    columns = sorted(found.columns)
    assert columns == sorted(names)
    other = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == other


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
