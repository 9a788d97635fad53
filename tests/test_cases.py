"""Every rule over units and forms of its own, and the tables and profiles of the sample units."""

from __future__ import annotations

import case_queries
import code_queries
import pytest
from test_oracles import compared


@pytest.mark.parametrize("name", list(case_queries.queries()))
def test_rules_find_what_is_stated(spark, name):
    compared(case_queries.queries()[name](spark, ""), case_queries.oracle_sql()[name])


@pytest.mark.parametrize("name", list(code_queries.queries()))
def test_tables_and_profiles_of_the_samples(spark, name):
    compared(code_queries.queries()[name](spark, ""), code_queries.oracle_sql()[name])
