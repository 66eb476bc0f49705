"""Every registered query with SQL gives the SQL's rows."""

from __future__ import annotations

import pytest

from oracle import connect, difference
from termforge.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, con, sf_dir, name):
    ours = catalogue.queries()[name](spark, sf_dir).toPandas()
    theirs = con.execute(catalogue.oracle_sql()[name]).df()
    assert difference(ours, theirs, 2e-6) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_give_rows(spark, sf_dir, name):
    rows = catalogue.queries()[name](spark, sf_dir)
    assert rows.count() > 0
