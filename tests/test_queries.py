"""Every registered query of the engine against its DuckDB twin on the smallest tables."""

import pytest
from compare import assert_equal, connect

from evalspark.plans import REGISTRY


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", REGISTRY)
def test_query(spark, con, sf, name):
    f, sql = REGISTRY[name]
    df = f(spark, sf)
    if sql is None:
        assert df.count() > 0
    else:
        assert_equal(df, con, sql)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(REGISTRY) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_nothing_outside_imports_the_optional_part():
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "evalspark"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"(import|from)\s.*\bllm\b", p.read_text()), p
