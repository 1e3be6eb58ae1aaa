"""Every registered report against its DuckDB twin on the small fixture."""

import pytest

import __spark_entry__ as E  # noqa: E402
from compare import compare_one, duck
from conftest import SF_SMALL

SQLS = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_matches_oracle(spark, con, name):
    r = compare_one(spark, con, name, SF_SMALL, E.queries()[name], SQLS[name])
    assert r["ok"], r


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["period_index", "label", "new_users", "recurring", "reactivated", "total_active", "lost"]
