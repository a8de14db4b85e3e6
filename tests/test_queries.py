"""Every core query against its SQL over the small tables, and the catalogue's shape."""

import pytest

import __spark_entry__ as entry
from codelode.plans import catalog

from .compare import same

AT = "/root/testdata/sf0.01"
ENTRIES = catalog.entries()


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if sql])
def test_equals_sql(spark, name):
    query, sql = ENTRIES[name]
    assert same(spark, AT, query, sql) == ""


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if not sql])
def test_runs(spark, name):
    assert ENTRIES[name][0](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
