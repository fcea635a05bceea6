"""The registered queries against their SQL."""

import pytest
from oracle import compare

from assayflow.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(spark, sf, name):
    assert compare(spark, sf, name, q.queries()[name], q.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_rows(spark, sf, name):
    assert q.queries()[name](spark, sf).count() > 0
