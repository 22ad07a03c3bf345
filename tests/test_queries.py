import pytest

from tessera.plans import documents  # noqa: F401 - registers its queries
from tessera.plans.queries import QUERIES, SQL

from .oracle import connect, same

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
