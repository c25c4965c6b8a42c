"""Every core query against its SQL, or against being runnable."""

import pytest
from oracle import connect, rows

from quarrylens.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf_dir, con):
    got = registry.QUERIES[name](spark, sf_dir)
    if name not in registry.ORACLE:
        frame = got.toPandas()
        assert len(frame) and not frame.duplicated().any()
        return
    want = con.sql(registry.ORACLE[name]).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
