import pytest

from sluice.llm import queries as Q
from tests.compare import check


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, sf, name):
    check(Q.queries()[name](spark, sf), sf, Q.oracle_sql()[name])
