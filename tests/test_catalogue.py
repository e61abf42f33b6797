import pytest

from tableguard.plans import catalogue

from .conftest import same_rows


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query_agrees_with_its_sql(spark, data, duck, name):
    same_rows(catalogue.queries()[name](spark, data), duck.execute(catalogue.oracle_sql()[name]))


def test_entry(spark, data):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["column", "check", "count"] and df.count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
