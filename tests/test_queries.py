"""Every registered query against its SQL, or at least to the end."""

from __future__ import annotations

import oracle
import pytest

from panelmill import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, sf, name):
    assert oracle.difference(QUERIES[name](spark, sf), duck, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.collect()


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["st", "st1", "n", "prob"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
