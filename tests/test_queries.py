"""Every registered query against its SQL, over whole tables."""

import os

import pytest

from compare import connect, differences
from corpusgauge import session
from corpusgauge.operators import joins, quantiles
from corpusgauge.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


CONSULTED = set()  # queries that ask for a bound
TINY = {"smallRows": 20, "smallBytes": 2000, "hashRows": 50, "hotKeys": 16, "accuracy": 40}


@pytest.fixture
def watch(monkeypatch, request):
    """Note that a query's plan depends on a bound."""

    def noted(*args):
        CONSULTED.add(request.node.callspec.params["name"])
        return session.setting(*args)

    monkeypatch.setattr(joins, "setting", noted)
    monkeypatch.setattr(quantiles, "setting", noted)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name, watch):
    got = QUERIES[name](spark, SF).toPandas()
    assert differences(got, con.execute(ORACLE[name]).df()) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql_beyond_all_bounds(spark, con, name):
    """The plans that large tables take: nothing is small, groups are big, tasks hold little."""
    if CONSULTED and name not in CONSULTED:
        pytest.skip("the plan depends on no bound")
    for key, value in TINY.items():
        spark.conf.set(f"spark.corpusgauge.{key}", str(value))
    try:
        got = QUERIES[name](spark, SF).toPandas()
    finally:
        for key in TINY:
            spark.conf.unset(f"spark.corpusgauge.{key}")
    assert differences(got, con.execute(ORACLE[name]).df()) is None
