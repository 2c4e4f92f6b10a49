"""Every core query against its SQL, on the smallest tables."""

import pytest

from partita.plans import registry
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, sf, name):
    assert compare(spark, sf, registry.QUERIES[name], registry.ORACLE[name]) >= 0


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns and df.limit(1).count() >= 0


def test_modules_keep_apart():
    from pathlib import Path

    root = Path(registry.__file__).parents[1]
    for p in root.rglob("*.py"):
        if root / "llm" not in p.parents:
            assert "partita.llm" not in p.read_text(), p
