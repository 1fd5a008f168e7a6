"""Every registered query of the domain against its SQL in DuckDB."""

import pytest
from conftest import DATA, rows_of

from tickwarden.plans import registered as queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_oracle(spark, oracle, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert rows_of(got) == rows_of(oracle.sql(queries.ORACLE[name]).df())


def test_entry_has_rows_and_no_fixed_input(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
