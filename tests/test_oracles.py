"""Every registered query against its DuckDB oracle (sf0.001), and the
rows-only queries for a stable, non-empty run."""

import pytest

from sluice.plans.compare import compare
from sluice.plans.registry import all_oracles, all_queries

from .conftest import SMOKE_DIR

QUERIES = all_queries()
ORACLES = all_oracles()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, key):
    res = compare(spark, key, SMOKE_DIR, QUERIES[key], ORACLES[key])
    assert res["columns_match"], res
    assert res["types_match"], res
    assert res["match"], res


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, key):
    df = QUERIES[key](spark, SMOKE_DIR)
    assert df.count() > 0
    assert df.schema == QUERIES[key](spark, SMOKE_DIR).schema


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
