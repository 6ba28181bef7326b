import pytest

from inkwell.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_its_sql(name, spark, sf_dir, duck, same_rows):
    same_rows(catalog.QUERIES[name](spark, sf_dir), duck.sql(catalog.SQL[name]))


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = catalog.QUERIES["project_documents"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src1)" in plan
    plan = catalog.QUERIES["workspace_totals"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "text:string" not in plan
