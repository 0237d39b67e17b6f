"""Every registered query of the reference's operators: against its SQL, or for a stable schema where SQL has no words for it."""

import pytest

import __spark_entry__ as entry
from tests.compare import duck_rows, spark_rows
from tilewright.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(spark, sf_dir, name):
    columns, rows = spark_rows(registry.QUERIES[name](spark, sf_dir))
    expected_columns, expected = duck_rows(registry.ORACLE[name], sf_dir)
    assert columns == expected_columns
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_point(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.schema == entry.entry(spark).schema
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_of_the_library_does_not_import_llm():
    from pathlib import Path

    top = Path(registry.__file__).parents[1]
    for p in top.rglob("*.py"):
        if "llm" not in p.relative_to(top).parts:
            assert "tilewright.llm" not in p.read_text(), p
