"""Every query of the library's own operators against its SQL on the smallest tables."""

import os

import pytest

from tests.sql_compare import same
from weftlab.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
#: The two jobs take minutes; tests/test_operators.py runs them on small tables and looks at their values.
JOBS = {"discover_biclusters", "significance_report"}
WITHOUT_SQL = sorted(set(registry.queries()) - set(registry.oracle_sql()) - JOBS)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
