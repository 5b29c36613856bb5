"""Every registered query that has SQL must give the same rows as the SQL."""

import oracle
import pytest

from logtide.plans import catalog

ENTRIES = catalog.entries()


@pytest.fixture(scope="module")
def db(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql is not None])
def test_query_matches_sql(spark, db, folder, name):
    _, _, problem = oracle.compare(spark, db, name, ENTRIES[name], folder)
    assert not problem


def test_entry_point():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
