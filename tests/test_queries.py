"""Every query with SQL agrees with it on the smallest tables; the others run."""

import pytest
from helpers import rows, sql_rows

from sieveline.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, sf, duck, name):
    assert rows(catalogue.queries()[name](spark, sf)) == sql_rows(duck, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "rank"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
