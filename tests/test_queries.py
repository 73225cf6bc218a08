"""Every registered query of the library: against its SQL where there is one, else that it runs and has rows."""

import pytest

from brindle import plans

from .compare import connect, data_dir, rows_of, rows_of_sql

MAY_BE_EMPTY = {"P11_news_window", "F7_trusted_source", "S4_interval_join"}


@pytest.fixture(scope="module")
def duck():
    return connect(data_dir())


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    cols, rows = rows_of(plans.QUERIES[name](spark, data_dir()))
    sql_cols, sql_rows = rows_of_sql(duck, plans.ORACLE_SQL[name])
    assert cols == sql_cols
    assert rows == sql_rows


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, data_dir()).count() > 0 or name in MAY_BE_EMPTY


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
