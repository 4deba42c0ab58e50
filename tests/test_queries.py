"""Every query with SQL gives the SQL's rows; the others run."""

import pytest
from compare import SF, level, views

from fieldwatch.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    rows = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.SQL:
        want = views().sql(registry.SQL[name]).df()
        assert sorted(rows.columns) == sorted(want.columns)
        assert level(rows) == level(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["station", "flag", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
