import pytest

from sluice.plans import catalogue
from tests.compare import check

#: What these read has no SQL of its own: classes out of prose.
READERS = {"tenure_classify", "vehicle_classify"}


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, sf, name):
    check(catalogue.queries()[name](spark, sf), sf, catalogue.oracle_sql()[name])


def test_only_readers_have_no_sql():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == READERS


@pytest.mark.parametrize("name", sorted(READERS))
def test_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0
