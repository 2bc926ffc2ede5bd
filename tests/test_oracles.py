"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from conftest import same_as_oracle
from talkloom.plans import load, registry

load()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, sf, name):
    same_as_oracle(spark, duck, sf, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() >= 0


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["conv_id", "n_turns", "n_user", "n_assistant", "assistant_text"]
    assert set(e.oracle_sql()) <= set(e.queries())
