from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from check_oracles import compare, connect
from vecweave.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), sf_dir, name) is None


def test_contract(spark, sf_dir):
    assert set(entry_module.queries()) >= set(QUERIES) and set(entry_module.oracle_sql()) >= set(ORACLES)
    assert set(ORACLES) <= set(QUERIES)
    assert len(entry_module.entry(spark).collect()) > 0
