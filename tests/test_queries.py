import pytest

import __spark_entry__
from docloom.plans import registry as plans
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, sf_dir, name):
    assert_same(plans.QUERIES[name](spark, sf_dir), sf_dir, plans.SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
