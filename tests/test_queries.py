"""Every query with SQL gives the rows of its SQL in DuckDB; the others run."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import differences

from millrace.plans import catalog

SF = "/root/testdata/sf0.001"
#: The tables hold no such rows; test_operators.py has some.
EMPTY: set[str] = set()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    query, sql = catalog.queries()[name], catalog.oracle_sql().get(name)
    if sql is None:
        df = query(spark, SF)
        assert len(df.columns) == len(set(df.columns)) and df.count() > 0
    else:
        assert [x for x in differences(spark, query, sql, SF) if not (name in EMPTY and x == "no rows")] == []


def test_registry_names_are_stable():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
