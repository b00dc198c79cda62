import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import pytest
from compare import difference

import __spark_entry__ as entry
from tidemark.oracle import ORACLE
from tidemark.workload import QUERIES


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, sf, name):
    assert difference(spark, name, QUERIES[name], ORACLE[name], sf) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
