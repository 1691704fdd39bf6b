"""Every named query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import compare, connect

NAMES = sorted(queries())
MODELS = {"model_leaderboard", "score_batch", "trained_model_health", "demand_model"}


@pytest.fixture(scope="module")
def duck(request):
    return connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", [n for n in NAMES if n not in MODELS])
def test_matches_sql(spark, sf, duck, name):
    assert compare(spark, duck, sf, name) == ""


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
