"""Every registered query against its SQL on the given tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import compare, duck
from conftest import SF

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    if name not in ORACLES:
        assert queries()[name](spark, SF).count() > 0
        return
    # the session's zone is the driver's choice; queries pin their own
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    assert compare(spark, con, name, queries()[name], ORACLES[name], SF) is None


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows and {r["rank"] for r in rows} == {1, 2, 3, 4, 5}


def test_alert_counts_at_this_scale(spark):
    rows = queries()["alerts"](spark, SF).groupBy("rule").count().collect()
    assert {r.rule: r["count"] for r in rows} == {"error-burst": 101, "svc1-any": 189, "any-burst": 1615}
