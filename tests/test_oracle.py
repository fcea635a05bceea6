"""Every registered query of the extraction operators against its SQL, or at least its rows."""

import pytest
from oracle import compare

from assayflow.plans import queries as plans


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_sql(spark, sf, name):
    assert compare(spark, sf, name, plans.queries()[name], plans.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_rows(spark, sf, name):
    assert plans.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
