"""Queries with SQL give the SQL's rows."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import connect, difference

from termforge.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    ours = queries.queries()[name](spark, sf_dir).toPandas()
    theirs = connect(sf_dir).execute(queries.oracle_sql()[name]).df()
    assert difference(ours, theirs) == ""
