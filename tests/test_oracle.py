"""Every registered query with an oracle equals DuckDB on the same tables."""

import pytest

from tallyspark.plans import ORACLE, QUERIES
from harness import compare

NAMES = sorted(ORACLE)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, sf, name):
    r = compare(spark, duck, name, QUERIES[name], ORACLE[name], sf)
    assert "error" not in r, r


def test_every_query_has_a_callable():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 100
